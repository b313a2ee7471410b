"""JSON arrays read by many tasks, and records in the order of their files."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from dialoom.operators.ranking import prefix_sums
from dialoom.schema import CONVERSATION
from dialoom.sources import conversations as src
from dialoom.sources.in_order import load_in_order, scan_lines
from dialoom.sources.json_arrays import scan_array_records

H, G = "human", "gpt"


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, several to a file and several files to a task."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("700", "10")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _records(n, seed):
    rng = random.Random(seed)
    said = ['}{"x"}', "\\", '\\"', "[{", "]}", "é日本", "", 'say "}" twice }}}', "a\nb\r\n}", "},\n  {", "plain words here", "{" * 9]
    return [
        {"id": f"r_{i}", "conversations": [
            {"from": rng.choice([H, G]), "value": "".join(rng.choice(said) for _ in range(rng.randint(0, 6)))}
            for _ in range(rng.randint(0, 5))
        ]} for i in range(n)
    ]


LAYOUTS = {
    "compact": lambda r: json.dumps(r, separators=(",", ":"), ensure_ascii=False),
    "plain": lambda r: json.dumps(r),
    "four": lambda r: json.dumps(r, indent=4, ensure_ascii=False) + "\n",
    "crlf": lambda r: "\r\n " + json.dumps(r, indent=1).replace("\n", "\r\n") + "\r\n\r\n",
    "tabs": lambda r: json.dumps(r, indent="\t", ensure_ascii=False),
}


def _as_text(df):
    return sorted(json.dumps([r["id"], [t.asDict() for t in r["conversations"]]], sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
@pytest.mark.parametrize("n", [0, 1, 2, 150])
def test_array_in_any_layout(spark, tmp_path, small_splits, layout, n):
    records = _records(n, n)
    path = tmp_path / "x.json"
    path.write_bytes(LAYOUTS[layout](records).encode())
    made = scan_array_records(spark, str(path))
    rows = sorted(made.collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(n))
    assert [json.loads(r["value"]) for r in rows] == records
    if n == 150:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
        both = [src.scan_conversations_json(spark, str(path), CONVERSATION, way) for way in ("any", "array")]
        assert _as_text(both[0]) == _as_text(both[1])


def test_records_longer_than_splits_and_several_files(spark, tmp_path, small_splits):
    long = [{"id": "long", "conversations": [{"from": H, "value": "}\"{" * 900}] * 2}]
    files = {"a.json": _records(20, 1) + long + _records(3, 2), "b.json": [], "c.json": long * 2, "d.json": _records(5, 3)}
    for name, records in files.items():
        (tmp_path / name).write_text(json.dumps(records, indent=2))
    rows = sorted(scan_array_records(spark, str(tmp_path)).collect(), key=lambda r: r["idx"])
    assert [json.loads(r["value"]) for r in rows] == [r for records in files.values() for r in records]
    assert [r["idx"] for r in rows] == list(range(31))


@pytest.mark.parametrize("text", ['{"id": "a"}', '[{"id": "a"}', '[{"id": "a"}, 5]', '[1, {"id": "a"}]', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"}]]', '["a"]'])
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        src.load_conversations(spark, str(path)).collect()


def test_lines_in_the_order_of_files(spark, tmp_path, small_splits):
    lines = [json.dumps(r) for r in _records(120, 4)]
    (tmp_path / "b.jsonl").write_text("\n".join(lines[50:]))
    (tmp_path / "a.jsonl").write_text("\n\n".join(lines[:50]) + "\n  \n")
    made = scan_lines(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 5
    assert [r["value"] for r in sorted(made.collect(), key=lambda r: r["idx"])] == lines
    read = load_in_order(spark, str(tmp_path), "jsonl")
    assert [r["id"] for r in read.orderBy("idx").collect()] == [f"r_{i}" for i in range(120)]
    loose = load_in_order(spark, str(tmp_path), "jsonl", None)
    assert [r["id"] for r in loose.filter("idx >= 40 AND idx < 60").orderBy("idx").collect()] == [f"r_{i}" for i in range(40, 60)]


def test_parquet_in_the_order_of_files(spark, tmp_path):
    for part in range(3):
        rows = spark.range(part * 100, part * 100 + 100, 1, 1).selectExpr("concat('r_', id) AS id", "id AS n")
        rows.write.parquet(str(tmp_path / f"ultra/{part}"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for part in range(3):
        source = next((tmp_path / f"ultra/{part}").glob("part-*.parquet"))
        shutil.copy(source, flat / f"{part}.parquet")
    rows = load_in_order(spark, str(flat), "parquet").collect()
    assert sorted((r["idx"], r["n"]) for r in rows) == [(i, i) for i in range(300)]


def test_prefix_sums(spark):
    df = spark.range(100).selectExpr("id % 10 AS a", "id AS b", "id * 3 AS v", "IF(id % 3 = 0, NULL, id % 3) AS g")
    rows = sorted(prefix_sums(df, ["a", "b"], "v", "before", part_rows=7).collect(), key=lambda r: r[:2])
    by_group = sorted(prefix_sums(df, ["a", "b"], "v", "before", ["g"], 7).collect(), key=lambda r: r[:2])
    total, totals = 0, {}
    for r, g in zip(rows, by_group):
        assert r["before"] == total and g["before"] == totals.get(g["g"], 0)
        total += r["v"]
        totals[g["g"]] = totals.get(g["g"], 0) + g["v"]
    assert len(rows) == len(by_group) == 100
