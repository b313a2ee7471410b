import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialoom.functions.hashing import hex_threshold
from dialoom.operators import sampling
from dialoom.operators.ranking import cut_by_hash, places, rank_by_hash, rank_by_order


def digest(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def _ids(spark, n):
    return spark.range(n).select(F.concat(F.lit("r_"), "id").alias("id"), F.col("id").alias("n"))


def test_shuffle_is_the_order_of_digests(spark):
    ids = [f"r_{i}" for i in range(500)]
    want = {k: r for r, k in enumerate(sorted(ids, key=digest))}
    for parts in (1, 7):
        rows = sampling.seeded_shuffle(_ids(spark, 500).repartition(parts)).collect()
        assert {r["id"]: r["rank"] for r in rows} == want


@pytest.mark.parametrize("n, ratio", [(0, 0.95), (1, 0.95), (19, 0.95), (20, 0.95), (100, 0.29), (50, 1.0)])
def test_split_sizes_are_exact(spark, n, ratio):
    split = sampling.exact_split(_ids(spark, n), ratio=ratio)
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    train = int(n * ratio)
    assert got.get("train", 0) == train and got.get("test", 0) == n - train


def test_approximate_split_and_sample_do_not_depend_on_partitions(spark):
    df = _ids(spark, 4000)
    approx = sampling.exact_split(df, mode="approx").filter("split = 'train'")
    kept = {f"r_{i}" for i in range(4000) if digest(f"r_{i}")[:8] < hex_threshold(0.95)}
    assert {r["id"] for r in approx.collect()} == kept and 3700 < len(kept) < 3900
    one, two = (
        {r["id"] for r in sampling.bernoulli_sample(df.repartition(p), p=0.1).collect()}
        for p in (1, 9)
    )
    assert one == two and 300 < len(one) < 500
    assert sampling.bernoulli_sample(df, p=0.0).count() == 0
    copies = df.withColumn("id", F.lit("same"))
    assert 300 < sampling.bernoulli_sample(copies, None, p=0.1).count() < 500
    with pytest.raises(ValueError):
        sampling.exact_split(df, mode="other")
    with pytest.raises(ValueError):
        hex_threshold(1.5)


def _is_permutation(rows, n):
    return sorted(r["rank"] for r in rows) == list(range(n)) and {r["n_rows"] for r in rows} == {n}


def test_hot_key_is_cut_up(spark):
    """A third of all rows share a key; ranks stay exact and the hot bucket is spread."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("r_"), "id")).alias("id"),
        F.col("id").alias("body"),
    )
    plain = rank_by_hash(df, "id", 1)
    cut = rank_by_hash(df, "id", 1, hot_rows=100)
    assert _is_permutation(plain.collect(), 3000)
    rows = cut.collect()
    assert _is_permutation(rows, 3000)
    again = {(r["id"], r["body"]): r["rank"] for r in rank_by_hash(df.repartition(5), "id", 1, hot_rows=100).collect()}
    assert again == {(r["id"], r["body"]): r["rank"] for r in rows}
    ordered = [r["id"] for r in sorted(plain.collect(), key=lambda r: r["rank"])]
    assert ordered == sorted(ordered, key=lambda k: digest(k, 1))
    for hot_rows in (1, 7, 100, 10**9):
        other = rank_by_hash(df, "id", 1, hot_rows=hot_rows).collect()
        assert {(r["id"], r["body"]): r["rank"] for r in other} == again


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.95])
def test_split_is_exact_with_repeated_keys(spark, ratio):
    """Also when the cut goes through the rows of one key, equal in every column or not."""
    for body in (F.col("id"), F.lit(0)):
        df = spark.range(1000).select(F.lit("same").alias("id"), body.alias("body"))
        split = sampling.exact_split(df, ratio=ratio, hot_rows=100, frozen=True)
        got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
        assert got == {"train": int(1000 * ratio), "test": 1000 - int(1000 * ratio)}


def test_equal_rows_need_numbers_of_their_own(spark):
    df = spark.range(900).select(F.lit("same").alias("id"), F.lit(0).alias("body"))
    rows = rank_by_hash(df, "id", 1, hot_rows=100, frozen=True).collect()
    assert _is_permutation(rows, 900) and rows[0].asDict().keys() == {"id", "body", "rank", "n_rows"}


def test_rank_by_order(spark):
    values = [5, 5, -3, 1000, 17, 250_000]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v bigint, i int")
    for bucket_rows in (1, 2, 100):
        rows = rank_by_order(df, "v", tie=["i"], bucket_rows=bucket_rows).collect()
        ranks = {r["i"]: r["rank"] for r in rows}
        assert {ranks.pop(0), ranks.pop(1)} == {1, 2} and ranks == {2: 0, 4: 3, 3: 4, 5: 5}


def test_sparse_and_null_order_values(spark):
    """No value is lost, whatever lies between values, and no bucket size changes a rank."""
    number = F.when(F.col("id") % 10 == 0, None).otherwise(F.xxhash64("id"))
    df = spark.range(3000).select(number.alias("v"), F.col("id").alias("i"))
    seen = []
    for options in ({}, {"bucket_rows": 50}, {"bucket_rows": 50, "hot_rows": 20}, {"hot_rows": 1}):
        rows = rank_by_order(df, "v", **options).collect()
        assert _is_permutation(rows, 3000)
        in_order = [r["v"] for r in sorted(rows, key=lambda r: r["rank"])]
        assert in_order[:300] == [None] * 300 and in_order[300:] == sorted(in_order[300:])
        seen.append({r["i"]: r["rank"] for r in rows})
    assert all(s == seen[0] for s in seen)


def test_hot_order_value_is_cut_up(spark):
    df = spark.range(2000).select((F.col("id") % 4 % 3).alias("v"), F.col("id").alias("i"))
    rows = rank_by_order(df, "v", hot_rows=100).collect()
    assert _is_permutation(rows, 2000)
    in_order = [r["v"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert in_order == sorted(in_order)


def test_slice(spark):
    df = spark.createDataFrame([(v,) for v in (30, 10, 20, 40)], "v bigint")

    def got(*bounds):
        return sorted(r["v"] for r in sampling.slice_by_index(df, *bounds, order="v").collect())

    assert got(1, 3) == [20, 30]
    assert got(2) == [30, 40]
    assert got(3, 99) == [40]
    assert got(9) == []


def test_order_by_suffix(spark):
    df = spark.createDataFrame([("a_10",), ("b_2",), ("plain",), ("x_y_3",)], "id string")
    rows = sampling.order_by_id_suffix(df).collect()
    assert [(r["id"], r["suffix"]) for r in rows] == [("plain", 0), ("b_2", 2), ("x_y_3", 3), ("a_10", 10)]
    bad = spark.createDataFrame([("a_x",)], "id string")
    with pytest.raises(PySparkException, match="not a number"):
        sampling.order_by_id_suffix(bad).collect()


@pytest.mark.parametrize("n, world", [(10, 4), (12, 4), (2, 5), (1, 7), (9, 1)])
def test_workers_get_equal_shares(spark, n, world):
    rows = sampling.shard_for_ranks(_ids(spark, n), world, epoch=2).collect()
    total = -(-n // world) * world
    assert sorted(r["position"] for r in rows) == list(range(total))
    assert all(r["worker"] == r["position"] % world for r in rows)
    assert sum(r["is_pad"] for r in rows) == total - n
    order = sorted((f"r_{i}" for i in range(n)), key=lambda k: digest(k, 44))
    by_position = {r["position"]: r["id"] for r in rows}
    assert [by_position[p] for p in range(total)] == [order[p % n] for p in range(total)]


def test_test_rows_keep_their_order_and_epochs_differ(spark):
    df = _ids(spark, 11)
    rows = sampling.shard_for_ranks(df, 3, shuffle=False, order="n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["position"])] == list(range(11)) + [0]
    orders = {
        tuple(r["id"] for r in sorted(sampling.shard_for_ranks(df, 3, e).collect(), key=lambda r: r["position"]))
        for e in range(3)
    }
    assert len(orders) == 3
    batches = sampling.assign_microbatches(sampling.shard_for_ranks(df, 3), 3)
    sizes = {(r["worker"], r["microbatch"]): r["count"] for r in batches.groupBy("worker", "microbatch").count().collect()}
    assert sizes == {(w, b): (3, 1)[b] for w in range(3) for b in range(2)}
    for bad in (lambda: sampling.shard_for_ranks(df, 0), lambda: sampling.assign_microbatches(batches, 0)):
        with pytest.raises(ValueError):
            bad()


def _spied(monkeypatch, name):
    """How often a method of DataFrames is called from now on."""
    from pyspark.sql.classic.dataframe import DataFrame

    calls, own = [], getattr(DataFrame, name)
    monkeypatch.setattr(DataFrame, name, lambda self, *a, **k: (calls.append(a), own(self, *a, **k))[1])
    return calls


def test_split_finds_its_cut_in_two_scans_at_most(spark, monkeypatch):
    df = _ids(spark, 5000)
    scans = _spied(monkeypatch, "collect")
    split = sampling.exact_split(df, ratio=0.37)
    assert 1 <= len(scans) <= 2
    assert {r["id"] for r in split.filter("split = 'train'").collect()} == set(
        sorted((f"r_{i}" for i in range(5000)), key=digest)[:1850]
    )


def test_cut_by_longer_prefixes(spark):
    """Many digests with one beginning: four more digits a scan, to the same end."""
    df = _ids(spark, 2000).unionByName(_ids(spark, 50))
    plain = cut_by_hash(df, "id", 3, 0.61)
    assert cut_by_hash(df, "id", 3, 0.61, few_rows=0) == plain
    ordered = sorted(digest(f"r_{i}", 3) for i in [*range(2000), *range(50)])
    place = int(2050 * 0.61)
    assert plain.digest == ordered[place] and plain.at_digest == place - ordered.index(ordered[place])


def test_split_without_a_key(spark):
    """Records without ids are known by their content; equal ones are split as well."""
    df = spark.range(400).select((F.col("id") % 300).alias("n"), F.array(F.lit("x")).alias("turns"))
    one, two = (
        sorted((r["n"], r["split"]) for r in sampling.exact_split(df.repartition(p), None, 0.5).collect())
        for p in (1, 6)
    )
    assert one == two and sum(s == "train" for _, s in one) == 200


def test_rank_sorts_narrow_rows_in_bounded_ranges(spark, monkeypatch):
    """A third of all rows share a key: ranges stay small, and only sort values, hashes and locators
    are dealt out for the ranks."""
    import dialoom.operators.ranking as ranking

    stored, own = [], ranking.freeze
    monkeypatch.setattr(ranking, "freeze", lambda df: stored.append(own(df)) or stored[-1])
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("id"),
        F.repeat(F.lit("x"), 50).alias("body"),
        F.col("id").alias("n"),
    )
    rows = rank_by_hash(df, "id", 1, hot_rows=1000).collect()
    assert _is_permutation(rows, 30_000)
    _, narrow, ranged = stored
    assert narrow.columns == ["_value", "_tie", "_tie2", "_row"] and ranged.columns == [*narrow.columns, "_at"]
    sizes = [r["count"] for r in ranged.groupBy(F.shiftright("_at", 33)).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 20 and max(sizes) < 4000


def test_places_in_groups(spark):
    """Places count within each group, a null one included, one group with most rows."""
    group = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "b").otherwise("a")
    df = spark.range(5000).select(group.alias("g"), F.xxhash64("id").alias("h"))
    rows = places(df, ["h"], ["g"], part_rows=300).collect()
    by_group = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        by_group.setdefault(r["g"], []).append((r["place"], r["n_rows"]))
    assert by_group.keys() == {None, "a", "b"}
    for found in by_group.values():
        assert found == [(i, len(found)) for i in range(len(found))]
    assert places(df.limit(0), ["h"], ["g"]).collect() == []
