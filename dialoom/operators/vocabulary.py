"""Draft vocabulary: token counts, the kept tokens, id maps and lookups.

Frequency tables have at most one row per token id, so their size is bounded by the
tokenizer's vocabulary and not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dialoom.functions.tokens import RegexTokenizer
from dialoom.session import broadcast_if_bounded, freeze


def _supervised(features: DataFrame, seq: str | None) -> DataFrame:
    """One row per position whose mask is 1: ``token`` and, with ``seq``, where it is ``seen``."""
    zipped = F.arrays_zip(F.col("input_ids").alias("token"), F.col("loss_mask").alias("m"))
    if seq is None:
        kept = F.filter(zipped, lambda z: z["m"] == 1)
        return features.select(F.explode(kept).alias("t")).select("t.token")
    return (
        features.select(F.col(seq).cast("bigint").alias("_seq"), F.posexplode(zipped).alias("_pos", "t"))
        .filter(F.col("t.m") == 1)
        .select("t.token", F.struct(F.col("_seq").alias("seq"), F.col("_pos").alias("pos")).alias("seen"))
    )


def _count(tokens: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("freq")]
    if "seen" in tokens.columns:
        aggregates.append(F.min("seen").alias("first_seen"))
    return tokens.groupBy(F.col("token").alias("token_id")).agg(*aggregates)


def token_frequency(features: DataFrame, seq: str | None = None) -> DataFrame:
    """Supervised occurrences per token id: ``token_id, freq``.

    With ``seq`` (an integer row order) also ``first_seen``: the row and the position of the
    first occurrence, as a pair that compares in that order. Counting is a partial aggregate
    before the shuffle, so each task sends at most one row per id of the vocabulary.
    """
    return _count(_supervised(features, seq))


def text_token_frequency(texts: DataFrame, tokenizer: RegexTokenizer, text: str = "text") -> DataFrame:
    """Token counts of whole texts with every position supervised."""
    return _count(texts.select(F.explode(tokenizer.ids(F.col(text))).alias("token")))


def merge_token_counts(*counts: DataFrame) -> DataFrame:
    """Sum of partial counts; a ``first_seen`` present in all of them keeps its minimum."""
    merged = counts[0]
    for more in counts[1:]:
        merged = merged.unionByName(more)
    aggregates = [F.sum("freq").alias("freq")]
    if all("first_seen" in c.columns for c in counts):
        aggregates.append(F.min("first_seen").alias("first_seen"))
    return merged.groupBy("token_id").agg(*aggregates)


def top_n_tokens(freq: DataFrame, n: int, ties: str = "first_seen") -> DataFrame:
    """The ``n`` most frequent tokens; ties by first occurrence or by id."""
    if ties not in ("first_seen", "token_id"):
        raise ValueError(f"unknown ties: {ties}")
    return freq.orderBy(F.desc("freq"), F.col(ties), F.col("token_id")).limit(n)


def coverage_ratio(freq: DataFrame, n: int) -> DataFrame:
    """Share of all occurrences that the ``n`` most frequent tokens cover, as one row.

    Which of several tied tokens are kept does not matter here. An empty table fails the job.
    """
    by_freq = Window.orderBy(F.desc("freq"), "token_id")  # at most one row per token id
    place = freq.select("freq", F.row_number().over(by_freq).alias("place"))
    sums = place.agg(
        F.sum(F.when(F.col("place") <= n, F.col("freq")).otherwise(0)).alias("top_freq"),
        F.sum("freq").alias("total_freq"),
    )
    nothing = F.raise_error(F.lit("no usable samples left")).cast("double")
    return sums.withColumn(
        "coverage",
        F.coalesce(F.try_divide(F.col("top_freq"), F.col("total_freq")), nothing),
    )


def draft_to_target(top: DataFrame) -> DataFrame:
    """Kept tokens by id: ``draft_id`` from 0, ``token_id``, their difference ``offset``.

    Other columns of ``top`` stay.
    """
    by_token = Window.orderBy("token_id")  # the kept tokens only
    return top.withColumn("draft_id", F.row_number().over(by_token) - 1).withColumn(
        "offset", F.col("token_id") - F.col("draft_id")
    )


def target_in_draft(
    spark: SparkSession, vocab: DataFrame, vocab_size: int, draft_size: int | None = None
) -> DataFrame:
    """For every token id below ``vocab_size`` whether the draft vocabulary has it."""
    bound = draft_size if draft_size is not None else vocab_size
    kept = vocab.select("token_id", F.lit(True).alias("_kept"))
    return (
        spark.range(vocab_size)
        .withColumnRenamed("id", "token_id")
        .join(broadcast_if_bounded(kept, bound), "token_id", "left")
        .select("token_id", F.coalesce("_kept", F.lit(False)).alias("in_draft"))
    )


def kept_positions(
    df: DataFrame, vocab: DataFrame, vocab_size: int, draft_size: int | None = None,
    target: str = "target", alias: str = "kept",
) -> DataFrame:
    """Add an array with 1 where the draft vocabulary has the id in ``target`` and else 0.

    The vocabulary goes into the plan as one array by id, of ``vocab_size`` flags.
    """
    flags = target_in_draft(df.sparkSession, vocab, vocab_size, draft_size)
    listed = F.sort_array(F.collect_list(F.struct("token_id", F.col("in_draft").cast("int").alias("f"))))
    by_id = freeze(flags.agg(listed.alias("a")).select(F.transform("a", lambda x: x["f"])))
    kept = F.transform(target, lambda t: F.coalesce(F.get("_by_id", t), F.lit(0)))
    return df.withColumn("_by_id", by_id.scalar()).withColumn(alias, kept).drop("_by_id")


def mask_by_draft_vocab(
    tokens: DataFrame, vocab: DataFrame, draft_size: int | None = None, token: str = "target_id"
) -> DataFrame:
    """Add ``position_mask``: the row's mask where its target token is in the vocabulary."""
    kept = vocab.select(F.col("token_id").alias(token), F.lit(1).alias("_kept"))
    return (
        tokens.join(broadcast_if_bounded(kept, draft_size), token, "left")
        .withColumn("position_mask", F.col("mask") * F.coalesce("_kept", F.lit(0)))
        .drop("_kept")
    )


def decode_draft_ids(tokens: DataFrame, vocab: DataFrame, draft_size: int | None = None) -> DataFrame:
    """Add ``token_id = draft_id + offset`` for rows with a ``draft_id``."""
    maps = vocab.select("draft_id", "offset")
    return (
        tokens.join(broadcast_if_bounded(maps, draft_size), "draft_id")
        .withColumn("token_id", F.col("draft_id") + F.col("offset"))
        .drop("offset")
    )


def encode_token_ids(tokens: DataFrame, vocab: DataFrame, draft_size: int | None = None) -> DataFrame:
    """Add ``draft_id`` for rows whose ``token_id`` is in the vocabulary; others are left out."""
    maps = vocab.select("token_id", "draft_id")
    return tokens.join(broadcast_if_bounded(maps, draft_size), "token_id")
