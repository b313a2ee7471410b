import math
import random
import statistics

import duckdb
import pytest

import __spark_entry__ as entry
from dialoom.operators import metrics


def trimmed(values, ratio=0.2):
    k = int(len(values) * ratio)
    inner = sorted(values)[k : len(values) - k] if k else sorted(values)
    return statistics.fmean(inner or values)


def _latency(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "engine string, seconds double")


@pytest.mark.parametrize("margin", [0.0005, 0.1])
@pytest.mark.parametrize("accuracy", [10_000, 5])
def test_trimmed_mean_is_exact(spark, margin, accuracy):
    """Whatever the quality of the quantiles it starts from."""
    rng = random.Random(3)
    groups = {
        "n1": [4], "n4": [4, 1, 2, 3], "n5": [9, 1, 2, 3, 100], "n10": list(range(10)),
        "equal": [2.5] * 31,
        "hot": [1.0] * 400 + [rng.random() * 9 for _ in range(800)],
        "tail": [10 ** rng.uniform(-3, 6) for _ in range(1501)],
        "two": [0.0] * 20 + [1.0] * 80,
    }
    means = metrics.trimmed_mean_latency(
        _latency(spark, groups), "engine", margin=margin, accuracy=accuracy
    )
    got = {r["engine"]: r["latency"] for r in means.collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert got[name] == pytest.approx(trimmed(values), rel=1e-9), name


def test_trim_of_everything_uses_all_values(spark):
    means = metrics.trimmed_mean_latency(_latency(spark, {"x": [1, 2, 6]}), "engine", ratio=0.5)
    assert means.collect()[0]["latency"] == pytest.approx(2.0)
    means = metrics.trimmed_mean_latency(_latency(spark, {"x": [1, 2, 6, 9]}), "engine", ratio=0.5)
    assert means.collect()[0]["latency"] == pytest.approx(4.5)


def test_throughput_and_speedup(spark):
    lat = spark.createDataFrame([("r", "How to learn", 2.0)], "run string, prompt string, latency double")
    row = metrics.throughput(lat, max_tokens=256, batch=3).collect()[0]
    assert row["tokens_per_second"] == pytest.approx((3 + 256) * 3 / 2)
    base = spark.createDataFrame([("r", 3.0), ("only here", 1.0)], "run string, latency double")
    report = metrics.speedup_report(base, lat.select("run", "latency"), "run").collect()
    assert [(r["run"], r["speedup"]) for r in report] == [("r", 1.5)]


def test_rates_by_a_latency_of_zero(spark):
    """As in the SQL: infinite with the sign of the zero, NaN for nothing by nothing, null stays null."""
    values = [2.0, 0.0, -0.0, None, float("nan")]
    lat = spark.createDataFrame(
        [(i, "How to learn", v) for i, v in enumerate(values)], "run int, prompt string, latency double"
    )
    got = {r["run"]: r["tokens_per_second"] for r in metrics.throughput(lat, max_tokens=7).collect()}
    assert (got[0], got[1], got[2], got[3]) == (5.0, math.inf, -math.inf, None) and math.isnan(got[4])
    base = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 0.0), (3, 1.0)], "run int, latency double")
    report = metrics.speedup_report(base, lat.select("run", "latency"), "run").collect()
    got = {r["run"]: r["speedup"] for r in report}
    assert (got[0], got[1], got[3]) == (1.5, math.inf, None) and math.isnan(got[2])


def test_throughput_query_by_events_of_zero(spark, tmp_path):
    """The query against its SQL where an event took no time."""
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT * FROM (VALUES (0, 0, 'a b c'), (0, 1, NULL), (1, 0, '')) t(conv_id, turn, text)")
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 2.0), (8, 0.0), (9, 1.0)) t(event_id, value)")
    for name in ("conversations", "events"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    names = ["conv_id", "turn", "words", "tokens_per_second"]
    got = entry.queries()["throughput"](spark, str(tmp_path)).select(names).collect()
    want = con.sql(entry.oracle_sql()["throughput"]).select(*map(duckdb.ColumnExpression, names)).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert (0, 0, 3, math.inf) in want and (0, 1, None, None) in want


LOG = """Train Epoch [1/40], position 0,  Acc: 0.50
Train Epoch [1/40], position 1,  Acc: 0.70
 10%|#| Train Epoch [1/40], position 2,  Acc: 0.90
Train Epoch [1/40], position 0, pLoss: 2.00
Test Epoch [2/40], position 0,  Acc: 0.25
Test Epoch [2/40], other: 1
Valid Epoch [2/40], position 0,  Acc: 0.25
Train Epoch [10/40], position 0, pLoss:1
"""


def test_log_to_table(spark, tmp_path):
    from dialoom.plans.jobs import training_report

    path = tmp_path / "train.log"
    path.write_text(LOG)
    rows = {(r["split"], r["epoch"]): (r["Acc"], r["pLoss"]) for r in training_report(spark, str(path)).collect()}
    assert rows == {
        ("Train", 1): (pytest.approx(0.6), 2.0), ("Test", 2): (0.25, None), ("Train", 10): (None, 1.0),
    }


def test_log_without_metrics(spark):
    lines = spark.createDataFrame([("nothing",)], "value string")
    with pytest.raises(ValueError):
        metrics.parse_train_log(lines)
    assert metrics.parse_train_log(lines, require_rows=False).count() == 0


def test_workers_weigh_the_same(spark):
    rows = [("Train", 1, 0, "Acc", 0, 1.0), ("Train", 1, 0, "Acc", 0, 3.0), ("Train", 1, 0, "Acc", 1, 10.0)]
    steps = spark.createDataFrame(
        rows, "split string, epoch int, position int, metric string, worker int, value double"
    )
    assert metrics.epoch_metrics(steps).collect()[0]["value"] == pytest.approx(6.0)


def test_weighted_loss(spark):
    df = spark.createDataFrame([(1, p, 2.0) for p in range(3)], "step int, position int, loss double")
    assert metrics.weighted_position_loss(df, "step").collect()[0]["ploss"] == pytest.approx(2 * 2.44)


def test_acceptance(spark):
    """Two sequences, brute force over the definition; the last step finds nothing."""
    rng = random.Random(9)
    vocab, steps = {0, 2, 3, 5}, 4
    rows, want = [], {k: [0, 0] for k in (*range(steps), steps)}
    for s in range(2):
        target = [rng.randrange(6) for _ in range(12)]
        mask = [rng.randrange(2) for _ in range(12)]
        drafts = [[rng.randrange(6) for _ in range(12)] for _ in range(steps)] + [[]]
        rows.append((s, target, mask, [int(t in vocab) for t in target], drafts))
        for k in range(steps):
            for pos in range(12 - k):
                want[k][1] += mask[pos + k]
                right = drafts[k][pos] == target[pos + k] and target[pos + k] in vocab
                want[k][0] += mask[pos + k] * right
    got = metrics.acceptance_accuracy(
        spark.createDataFrame(rows, "seq int, target array<int>, mask array<int>, kept array<int>, drafts array<array<int>>")
    )
    assert {r["k"]: (r["hits"], r["positions"], r["accuracy"]) for r in got.collect()} == {
        k: (h, n, pytest.approx(h / (n + 1e-6))) for k, (h, n) in want.items()
    }
    assert want[steps] == [0, 0]


def test_null_groups_have_a_mean(spark):
    rows = [(None, float(i)) for i in range(10)] + [("a", 3.0)]
    means = metrics.trimmed_mean_latency(spark.createDataFrame(rows, "engine string, seconds double"), "engine")
    assert {r["engine"]: r["latency"] for r in means.collect()} == {None: pytest.approx(4.5), "a": 3.0}


def test_trimmed_mean_in_small_ranges(spark, monkeypatch):
    """Slices at the cuts are put in order range by range: the same mean, whatever the sizes."""
    import random

    import dialoom.operators.metrics as m
    from dialoom.operators.ranking import prefix_sums

    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.25, 3.0])) for g in ("a", None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "engine string, seconds double")
    monkeypatch.setattr(m, "prefix_sums", lambda *a: prefix_sums(*a, part_rows=40))
    got = {r["engine"]: r["latency"] for r in m.trimmed_mean_latency(df, "engine", margin=0.3).collect()}
    for g in ("a", None):
        values = sorted(v for e, v in rows if e == g)[300:1200]
        assert abs(got[g] - sum(values) / 900) < 1e-9
