"""Reproducible shuffle, split, sample, ordering, sharding and batch assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoom.functions.hashing import hex_threshold, seeded_hash
from dialoom.operators.ranking import cut_by_hash, rank_by_hash, rank_by_order
from dialoom.schema import SAMPLE_RATE, SEED, TRAIN_RATIO


def slice_by_index(
    df: DataFrame, start: int, end: int | None = None, order: str | None = None
) -> DataFrame:
    """Rows with ``start <= idx < end``; without ``order`` an ``idx`` column is expected.

    An end behind the last row is the same as no end.
    """
    if order is not None:
        df = rank_by_order(df, order).withColumnRenamed("rank", "idx").drop("n_rows")
    keep = F.col("idx") >= start
    if end is not None:
        keep &= F.col("idx") < end
    return df.filter(keep)


def seeded_shuffle(df: DataFrame, key: str = "id", seed: int = SEED, **ranking) -> DataFrame:
    """Add ``rank``, the position of each row in a reproducible permutation."""
    return rank_by_hash(df, key, seed, **ranking).drop("n_rows")


def exact_split(
    df: DataFrame,
    key: str | None = "id",
    ratio: float = TRAIN_RATIO,
    seed: int = SEED,
    mode: str = "exact",
    **ranking,
) -> DataFrame:
    """Add ``split``: the first ``int(n * ratio)`` rows of the permutation are ``train``.

    Two small jobs over the key column find the digest at which the cut lies; labelling the rows
    then needs no shuffle. Only rows that share the very key at the cut are ranked. ``key=None``
    takes the whole record as its key, for data without ids.
    ``mode="approx"`` compares digests with the ratio itself: no job at all, and sizes that
    are right on average.
    """
    if key is None:
        whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
        keyed = exact_split(df.withColumn("_key", whole), "_key", ratio, seed, mode, **ranking)
        return keyed.drop("_key")
    digest = seeded_hash(seed, F.col(key))
    if mode == "approx":
        low = F.substring(digest, 1, 8) < hex_threshold(ratio)
        return df.withColumn("split", F.when(low, "train").otherwise("test"))
    if mode != "exact":
        raise ValueError(f"unknown mode: {mode}")
    cut = cut_by_hash(df, key, seed, ratio)
    labelled = df.withColumn("split", F.when(digest < cut.digest, "train").otherwise("test"))
    if cut.at_digest == 0:
        return labelled
    at_cut = rank_by_hash(df.filter(digest == cut.digest), key, seed, **ranking)
    low = F.col("rank") < cut.at_digest
    at_cut = at_cut.withColumn("split", F.when(low, "train").otherwise("test"))
    return labelled.filter(digest != cut.digest).unionByName(at_cut.drop("rank", "n_rows"))


def bernoulli_sample(
    df: DataFrame, key: str | None = "id", p: float = SAMPLE_RATE, seed: int = SEED
) -> DataFrame:
    """Each row independently with probability ``p``.

    By a key the choice is the same on any partitioning, and rows with the same key share
    it. ``key=None`` draws for every row on its own, copies included; then the choice is
    repeatable for the same files read the same way.
    """
    if key is None:
        return df.sample(withReplacement=False, fraction=p, seed=seed)
    return df.filter(F.substring(seeded_hash(seed, F.col(key)), 1, 8) < hex_threshold(p))


def order_by_id_suffix(df: DataFrame, key: str = "id") -> DataFrame:
    """Sort by the integer behind the last ``_`` of the id, 0 for ids without one.

    A suffix that is not a number fails the job.
    """
    bad = F.raise_error(F.concat(F.lit("id suffix is not a number: "), F.col(key)))
    suffix = F.element_at(F.split(F.col(key), "_"), -1).try_cast("bigint")
    number = F.coalesce(suffix, bad.cast("bigint"))
    return df.withColumn(
        "suffix", F.when(F.contains(F.col(key), F.lit("_")), number).otherwise(F.lit(0))
    ).orderBy("suffix", key)


def shard_for_ranks(
    df: DataFrame,
    world: int,
    epoch: int = 0,
    shuffle: bool = True,
    key: str = "id",
    order: str | None = None,
    seed: int = SEED,
    **ranking,
) -> DataFrame:
    """Deal rows to ``world`` workers: adds ``position, worker, pos_in_worker, is_pad``.

    Rows are permuted anew per epoch, or kept in the order of the integer column ``order``.
    Workers get equal counts: leading rows are dealt again until the total divides, marked
    ``is_pad``. A row's own positions follow from its rank, so nothing is gathered for it.
    """
    if world < 1:
        raise ValueError("world must be at least 1")
    if shuffle:
        ranked = rank_by_hash(df, key, seed + epoch, **ranking)
    else:
        ranked = rank_by_order(df, order or key)
    total = (F.ceil(F.col("n_rows") / world) * world).cast("bigint")
    positions = F.sequence(F.col("rank"), total - 1, F.col("n_rows"))
    return (
        ranked.withColumn("position", F.explode(positions))
        .withColumn("worker", F.col("position") % world)
        .withColumn("pos_in_worker", F.floor(F.col("position") / world))
        .withColumn("is_pad", F.col("position") >= F.col("n_rows"))
        .drop("rank", "n_rows")
    )


def assign_microbatches(sharded: DataFrame, batch_size: int) -> DataFrame:
    """Add ``microbatch``: consecutive groups of ``batch_size`` rows of one worker."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    return sharded.withColumn("microbatch", F.floor(F.col("pos_in_worker") / batch_size))
