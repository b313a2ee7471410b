"""Incremental jobs over folders into which files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoom.functions.text import ChatTemplate
from dialoom.functions.tokens import RegexTokenizer, Tokenizer
from dialoom.operators.features import featurize
from dialoom.operators.records import clean_conversations
from dialoom.operators.vocabulary import token_frequency
from dialoom.schema import CONVERSATION
from dialoom.sources.conversations import Schema, coalesce_turn_fields, scan_conversations_jsonl


def stream_clean(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, max_files: int | None = None,
    schema: Schema = None,
) -> StreamingQuery:
    """Clean conversation files as they arrive and append them to ``out_dir``.

    Without ``schema`` the files present at the start tell which keys there are, and all are
    carried along. The file sink commits every micro-batch once, so a restart neither loses nor
    repeats records. Runs until all files present are done; start it again for later ones.
    """
    if schema is None:
        schema = scan_conversations_jsonl(spark, in_dir, None).schema
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        clean_conversations(reader.json(in_dir))
        .writeStream.format("json")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", False)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_token_frequency(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    tokenizer: RegexTokenizer,
    schema: str = "doc_id bigint, text string",
    max_files: int | None = None,
) -> StreamingQuery:
    """Running token counts over parquet files of texts.

    State has one row per token id. Each micro-batch appends the ids whose count it changed, with
    their new counts, to its own ``batch=N`` folder; a repeated batch replaces that folder.
    ``latest_frequency`` takes each id's newest count from folders whose write finished.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    tokens = reader.parquet(in_dir).select(
        F.explode(tokenizer.ids(F.col("text"))).alias("token_id")
    )
    return _save_counts(tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("freq")), out_dir, checkpoint)


def _save_counts(counts: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def stream_supervised_frequency(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    schema: Schema = CONVERSATION,
    max_len: int | None = None,
    policy: str = "reference",
    seq: str | None = None,
    on_error: str = "fail",
    max_files: int | None = None,
) -> StreamingQuery:
    """Running counts of supervised tokens over conversation files (JSONL) as they arrive.

    Records go through the same rendering, tokens and mask as ``token_frequency`` over a batch.
    State has one row per token id: its count and, with ``seq`` (an integer column with the order of
    the records), its first occurrence, whichever file brings it. Saved as in
    ``stream_token_frequency``.
    """
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    conv = coalesce_turn_fields(reader.json(in_dir))
    keep = ("id",) if seq is None else ("id", seq)
    features = featurize(conv, template, tokenizer, max_len, policy, on_error, keep)
    return _save_counts(token_frequency(features, seq), out_dir, checkpoint)


def latest_frequency(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest count of every token id that one of the streams above has saved.

    Counts only grow, so the newest is the greatest; first occurrences only move to the front. A
    folder whose write did not finish holds no visible files: Spark's committer moves them in at
    the end.
    """
    saved = spark.read.parquet(out_dir)
    newest = [F.max("freq").alias("freq")]
    if "first_seen" in saved.columns:
        newest.append(F.min("first_seen").alias("first_seen"))
    return saved.groupBy("token_id").agg(*newest)
