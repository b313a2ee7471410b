"""Exact places in an order, without a global sort of whole rows and without a single-task window.

Only narrow rows are sorted: the sort values, a hash of the tie columns and the number of the row
(its locator). Sampled splitters cut them into ranges of about ``part_rows`` rows; as the locator
is part of the sort key, no value and no key is too frequent for that. Each range is sorted by one
task, the sizes of the ranges give every range its first place, and the places are joined back to
the rows by locator, once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.hashing import seeded_hash
from dialoom.session import freeze

# Narrow rows that one task sorts, on average.
PART_ROWS = 250_000
HASH_DIGITS = 4
# Rows at a cut whose digests may come to the driver.
CUT_ROWS = 100_000
# Bits below the partition number in Spark's row numbers.
ROW_BITS = 33


def places(
    narrow: DataFrame, order: list[str | Column], group: list[str] = (), part_rows: int = PART_ROWS
) -> DataFrame:
    """``narrow`` with ``place``, the 0-based place of each row in its group, and ``n_rows``, the
    size of that group (the whole table without ``group``).

    Rows are ordered by ``order``, nulls first, in which no two should be equal: those would fall
    into one range, in any order. The rows are stored twice in the shared folder, so they should be
    narrow. Windows run over one row per range and group. Null groups are groups.
    """
    narrow = freeze(narrow)
    parts = max(1, -(-narrow.count() // part_rows))
    keys = [*group, *order]
    ranged = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = freeze(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", ROW_BITS))
    sizes = ranged.groupBy("_range", *group).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first")
    )
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_size").over(whole.orderBy("_range")) - F.col("_size")
    starts = sizes.select(
        F.col("_range").alias("_of"),
        *[F.col(c).alias(f"_of_{c}") for c in group],
        (before - F.col("_first")).alias("_shift"),
        F.sum("_size").over(whole).alias("n_rows"),
    )
    same = F.col("_range") == F.col("_of")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = ranged.join(starts, same)
    return placed.select(*narrow.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n_rows")


def prefix_sums(
    df: DataFrame, order: list[str], value: str, alias: str, group: list[str] = (), part_rows: int = PART_ROWS
) -> DataFrame:
    """``df`` with ``alias``, the sum of ``value`` over all rows of the group in front of each in ``order``.

    No two rows of a group share an order. For summaries, such as one row per file split or per distinct
    value: rows are stored twice, sorted by sampled ranges, and a window sees one row per range and group.
    """
    df = freeze(df)
    parts = max(1, -(-df.count() // part_rows))
    ranged = freeze(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_all"))
    line = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    starts = totals.select(
        F.col("_range").alias("_of"),
        *[F.col(c).alias(f"_of_{c}") for c in group],
        (F.sum("_all").over(line) - F.col("_all")).alias("_sum_before"),
    )
    same = F.col("_range") == F.col("_of")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = F.sum(value).over(Window.partitionBy("_range", *group).orderBy(*order)) - F.col(value)
    summed = ranged.withColumn("_sum_inside", inside).join(starts, same)
    return summed.select(*df.columns, (F.col("_sum_before") + F.col("_sum_inside")).alias(alias))


def _rank(
    df: DataFrame, value: Column, ties: list[str], part_rows: int, repeatable: bool
) -> DataFrame:
    """Add ``rank`` (from 0) and ``n_rows`` by ``value``, then two hashes of the tie columns.

    A row is known by its number. Unless a second reading is sure to number rows alike, they are
    stored with their numbers first.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    if not repeatable:
        rows = freeze(rows)
    narrow = rows.select(
        value.alias("_value"),
        F.shiftrightunsigned(F.xxhash64(*ties), 1).alias("_tie"),
        F.xxhash64(F.lit(1), *ties).alias("_tie2"),
        "_row",
    )
    found = places(narrow, ["_value", "_tie", "_tie2", "_row"], part_rows=part_rows)
    ranks = found.select("_row", F.col("place").alias("rank"), "n_rows")
    return rows.join(ranks, "_row").select(*df.columns, "rank", "n_rows")


def _ties(df: DataFrame, key: str, tie: list[str] | None) -> list[str]:
    """All columns but the key unless named. None is no choice: some order must hold."""
    return list(tie) if tie else [c for c in df.columns if c != key] or [key]


def rank_by_hash(
    df: DataFrame,
    key: str,
    seed: int,
    tie: list[str] | None = None,
    hot_rows: int = PART_ROWS,
    frozen: bool = True,
) -> DataFrame:
    """Add a seeded pseudo-random ``rank`` from 0 and the total ``n_rows``.

    The order is that of ``md5(seed:key)`` and depends neither on partitioning nor on ``hot_rows``,
    the rows a task sorts. Rows that share a key (a null one included) are ordered by hashes of the
    ``tie`` columns (all others by default); rows equal in these too come in any order, each with
    a rank of its own. ``frozen=False`` saves storing the rows: for a plain scan of files, or
    what filters and projections make of one, which Spark reads the same way every time.
    """
    digest = F.unhex(seeded_hash(seed, F.col(key)))
    return _rank(df, digest, _ties(df, key, tie), hot_rows, not frozen)


def rank_by_order(
    df: DataFrame,
    order: str,
    tie: list[str] | None = None,
    bucket_rows: int = PART_ROWS,
    hot_rows: int | None = None,
    frozen: bool = True,
) -> DataFrame:
    """Add ``rank`` from 0 and ``n_rows`` following a column, nulls first.

    Ties, ``frozen`` and the rows a task sorts (the lesser of ``bucket_rows`` and ``hot_rows``) are
    as in ``rank_by_hash``.
    """
    part_rows = min(bucket_rows, hot_rows or bucket_rows)
    return _rank(df, F.col(order), _ties(df, order, tie), part_rows, not frozen)


@dataclass(frozen=True)
class HashCut:
    """The first rows of the seeded order: all with ``md5(seed:key)`` below ``digest``, and
    ``at_digest`` of those equal to it (more than none only if keys repeat)."""

    digest: str
    at_digest: int


def cut_by_hash(
    df: DataFrame, key: str | Column, seed: int, ratio: float, few_rows: int = CUT_ROWS
) -> HashCut:
    """Where ``int(n * ratio)`` rows of the seeded order end.

    The first scan counts rows by the first four hex digits of their digests: at most 65,536 rows
    come to the driver, and the prefix at the cut is known. The second fetches the digests with
    that prefix. Only if these are more than ``few_rows`` rows and not all the same are prefixes
    made longer first, by four digits a scan.
    """
    hashed = df.select(seeded_hash(seed, F.col(key) if isinstance(key, str) else key).alias("_h"))
    prefix, want, few = "", None, False
    while True:
        part = F.col("_h") if few else F.substring("_h", 1, len(prefix) + HASH_DIGITS)
        counts = hashed.filter(F.col("_h").startswith(prefix)).groupBy(part.alias("_p")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high")
        )
        sizes = sorted((r["_p"], r["n"], r["low"], r["high"]) for r in counts.collect())
        if want is None:
            want = math.floor(sum(n for _, n, _, _ in sizes) * float(ratio))
        for prefix, n, low, high in sizes:
            if n > want:
                break
            want -= n
        else:  # no rows, or all of them are in front of the cut
            return HashCut("g", 0)
        if low == high:
            return HashCut(low, want)
        few = n <= few_rows
