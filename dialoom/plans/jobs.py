"""The jobs a user runs: regenerate, clean and split, build a vocabulary, report metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dialoom.functions.text import ChatTemplate
from dialoom.functions.tokens import Tokenizer
from dialoom.operators import metrics, records, sampling, vocabulary
from dialoom.operators.features import featurize
from dialoom.operators.ranking import rank_by_hash, rank_by_order
from dialoom.operators.regenerate import RetryPolicy, regenerate_replies
from dialoom.schema import (
    LOOSE_CONVERSATION,
    SAMPLE_RATE,
    SEED,
    TRAIN_RATIO,
)
from dialoom.session import freeze, fresh_path
from dialoom.sources import sinks
from dialoom.sources.conversations import (
    Schema,
    coalesce_turn_fields,
    load_conversations,
    scan_conversations_jsonl,
    scan_records_variant,
    scan_text_log,
)
from dialoom.sources.in_order import load_in_order


def clean_and_split(
    spark: SparkSession, source: str, target: str, full: bool = False,
    ratio: float = TRAIN_RATIO, seed: int = SEED, schema: Schema = None,
) -> DataFrame:
    """Clean a JSONL corpus; write it whole, or as ``split=train`` and ``split=test``.

    Without a ``schema`` records are cleaned as VARIANT: every key keeps its value. A schema drops
    the others. Records are split by the digests of their ids, or of their whole content if they
    have none (with a schema: if it has none). Returns the record counts of what was written, taken
    while writing.
    """
    counts = sinks.StageCounts(spark)
    if schema is None:
        cleaned = records.clean_variant(scan_records_variant(spark, source))
        text = F.to_json("record")
        key = F.coalesce(F.try_variant_get("record", "$.id", "string"), text)
        cleaned = cleaned.select(text.alias("value"), key.alias("_key"))
    else:
        cleaned = records.clean_conversations(scan_conversations_jsonl(spark, source, schema))
    if full:
        cleaned = counts.watch(cleaned, cleaned=F.lit(True))
        if schema is None:
            cleaned.select("value").write.text(target)
        else:
            sinks.write_jsonl(cleaned, target)
        return counts.table()
    if schema is None:
        split = sampling.exact_split(cleaned, "_key", ratio, seed).select("value", "split")
    else:
        split = sampling.exact_split(cleaned, "id" if "id" in cleaned.columns else None, ratio, seed)
    written = counts.watch(split, **{part: F.col("split") == part for part in ("train", "test")})
    writer = written.write.partitionBy("split")
    if schema is None:
        writer.text(target)
    else:
        writer.option("ignoreNullFields", False).json(target)
    return counts.table().withColumnRenamed("stage", "split").filter("records > 0")


def sample_corpus(
    spark: SparkSession, source: str, target: str, p: float = SAMPLE_RATE, seed: int = SEED
) -> None:
    """A share of a JSONL corpus; each line is kept or left out as it is, on its own."""
    lines = spark.read.text(source).filter(F.trim("value") != "")
    sampling.bernoulli_sample(lines, None, p, seed).write.text(target)


def indexed_corpus(df: DataFrame, order: str | None = None) -> DataFrame:
    """Records with a 0-based ``idx``, canonical roles and an id.

    ``order`` names an integer column that gives the corpus its order. Without one, and
    without an ``idx`` in the data, records are numbered in the order of their ids' digests,
    which is the same on every run; records without ids, or a data set without such a column,
    go by the digest of their content. Missing ids are made up from the index.
    """
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("string"))
    if order is not None:
        df = rank_by_order(df, order).withColumnRenamed("rank", "idx").drop("n_rows")
    elif "idx" not in df.columns:
        content = F.md5(F.to_json(F.struct(*sorted(df.columns))))
        keyed = df.withColumn("_key", F.coalesce(F.col("id").cast("string"), content))
        ranked = rank_by_hash(keyed, "_key", SEED, frozen=True)
        df = ranked.withColumnRenamed("rank", "idx").drop("n_rows", "_key")
    conv = records.keep_dialogue_roles(coalesce_turn_fields(df))
    made_up = F.concat(F.lit("regenerated_"), F.col("idx").cast("string"))
    return conv.withColumn("id", F.coalesce("id", made_up)).select("id", "idx", "conversations")


def _missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def finished_indexes(spark: SparkSession, target: str) -> DataFrame | None:
    """``idx`` of saved records without a failed reply; None if nothing was saved yet."""
    try:
        saved = sinks.scan_batches(spark, target)
    except AnalysisException as error:
        if _missing_path(error):
            return None
        raise
    failed = F.exists(F.coalesce("errors", F.array().cast("array<string>")), F.isnotnull)
    return saved.filter(~failed).select("idx").distinct()


def regenerate_corpus(
    spark: SparkSession,
    conv: DataFrame,
    target: str,
    generate: Callable[[str], str],
    batch_save: int,
    start_index: int,
    end_index: int,
    policy: RetryPolicy = RetryPolicy(),
    partitions: int | None = None,
    threads: int = 8,
    commits: int = 10,
) -> None:
    """Regenerate ``conv(id, idx, conversations)`` in at most ``commits`` saves.

    What is still to do is worked out once and stored in the shared folder, partitioned by
    commit, so each commit reads its own rows only and the corpus is read once. What a commit has
    written survives a stop. A second run leaves out every index that is there without a failed
    reply; one whose reply failed is asked for again, and merging prefers the better row.
    """
    todo = sampling.slice_by_index(conv, start_index, end_index)
    done = finished_indexes(spark, target)
    if done is not None:
        todo = todo.join(done, "idx", "left_anti")
    batches = -(-(end_index - start_index) // batch_save)
    step = batch_save * max(1, -(-batches // commits))
    commit = F.floor((F.col("idx") - start_index) / step).cast("int")
    folder = fresh_path(spark, "to-regenerate")
    todo.withColumn("commit", commit).write.partitionBy("commit").parquet(folder)
    stored = spark.read.schema(
        StructType([*todo.schema.fields, StructField("commit", IntegerType())])
    ).parquet(folder)
    for number in range(-(-(end_index - start_index) // step)):
        mine = stored.filter(F.col("commit") == number)
        replies = regenerate_replies(mine, generate, policy, partitions, threads)
        sinks.write_batches(replies, target, batch_save, start_index, mode="append")


def merge_corpus(spark: SparkSession, batches: str, target: str, dedupe: str | None = "idx") -> None:
    """Merge saved batches into one JSONL corpus at another path."""
    merged = sinks.merge_batches(sinks.scan_batches(spark, batches), dedupe)
    sinks.write_jsonl(merged.select("id", "conversations"), target)


def regenerate_dataset(
    spark: SparkSession, source: str, target: str, generate: Callable[[str], str],
    order: str | None = None, batch_save: int = 10, fmt: str | None = None,
    schema: Schema = LOOSE_CONVERSATION, **options,
) -> None:
    """From a dataset on disk, in any accepted spelling, to saved regenerated batches.

    Records are numbered by ``order``, or else by their place in the files, which are read by path.
    """
    if order is not None:
        conv = indexed_corpus(load_conversations(spark, source, fmt, schema), order)
    else:
        conv = indexed_corpus(load_in_order(spark, source, fmt, schema))
    end = options.pop("end_index", None)
    if end is None:
        end = conv.count()
    regenerate_corpus(
        spark, conv, target, generate, batch_save, options.pop("start_index", 0), end, **options
    )


@dataclass(frozen=True)
class DraftVocabulary:
    """Result of ``build_draft_vocab``; the two maps are bounded by the vocabulary."""

    frequency: DataFrame
    maps: DataFrame
    coverage: DataFrame
    draft_size: int
    vocab_size: int

    def target_in_draft(self) -> DataFrame:
        return vocabulary.target_in_draft(
            self.maps.sparkSession, self.maps, self.vocab_size, self.draft_size
        )


def build_draft_vocab(
    conv: DataFrame,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    draft_size: int,
    max_len: int | None = None,
    policy: str = "reference",
    ties: str = "first_seen",
    seq: str | None = None,
    on_error: str = "fail",
) -> DraftVocabulary:
    """Featurize, count supervised tokens and keep the ``draft_size`` most frequent.

    Equal counts go by first occurrence, which needs ``seq``, an integer column with the order of
    the records; ``ties="token_id"`` needs none.
    The frequency table, at most one row per token id, is stored in the session's shared
    folder, so that the corpus is read once for maps, coverage and membership.
    """
    if ties == "first_seen" and seq is None:
        raise ValueError("ties='first_seen' needs seq")
    keep = (seq,) if seq is not None else ()
    order = seq if ties == "first_seen" else None
    features = featurize(conv, template, tokenizer, max_len, policy, on_error, keep)
    frequency = freeze(vocabulary.token_frequency(features, order))
    top = vocabulary.top_n_tokens(frequency, draft_size, ties)
    return DraftVocabulary(
        frequency=frequency,
        maps=vocabulary.draft_to_target(top),
        coverage=vocabulary.coverage_ratio(frequency, draft_size),
        draft_size=draft_size,
        vocab_size=tokenizer.vocab_size,
    )


def feature_corpus(
    spark: SparkSession, source: str, target: str, template: ChatTemplate, tokenizer: Tokenizer,
    max_len: int | None = None, policy: str = "reference", on_error: str = "fail",
    fmt: str | None = None,
) -> DataFrame:
    """A cleaned chat corpus to feature rows in Parquet, which are returned."""
    conv = coalesce_turn_fields(load_conversations(spark, source, fmt, None))
    featurize(conv, template, tokenizer, max_len, policy, on_error).write.parquet(target)
    return spark.read.parquet(target)


def vocabulary_corpus(
    spark: SparkSession, source: str, target: str, template: ChatTemplate, tokenizer: Tokenizer,
    draft_size: int, max_len: int | None = None, on_error: str = "fail", fmt: str | None = None,
    ties: str = "first_seen",
) -> DataFrame:
    """A cleaned chat corpus to its draft vocabulary: maps and coverage in Parquet.

    Equal counts go by first occurrence in the files, read by path, or by ``ties="token_id"``, which
    saves finding the places of records. Returns the coverage.
    """
    if ties == "first_seen":
        conv, seq = coalesce_turn_fields(load_in_order(spark, source, fmt, None)), "idx"
    else:
        conv, seq = coalesce_turn_fields(load_conversations(spark, source, fmt, None)), None
    built = build_draft_vocab(
        conv, template, tokenizer, draft_size, max_len, ties=ties, seq=seq, on_error=on_error
    )
    built.maps.write.parquet(f"{target}/maps")
    built.coverage.write.parquet(f"{target}/coverage")
    return spark.read.parquet(f"{target}/coverage")


def training_report(spark: SparkSession, log: str) -> DataFrame:
    """A training log as one row per split and epoch with its mean metrics."""
    rows = metrics.parse_train_log(scan_text_log(spark, log))
    return metrics.pivot_metrics(metrics.log_epoch_means(rows))
