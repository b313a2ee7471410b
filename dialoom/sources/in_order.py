"""Corpora in the order in which their files hold them: by path, then by place in the file.

Lines know their split and their place in it. Counting the lines of each split, a row per split, gives
every split its first index, and so every line its own, without moving a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.operators.ranking import prefix_sums
from dialoom.schema import CONVERSATION
from dialoom.session import broadcast_if_bounded
from dialoom.sources.conversations import Schema, format_of, scan_parquet_dir
from dialoom.sources.json_arrays import scan_array_records


def _with_idx(rows: DataFrame, split: list[str], line: str) -> DataFrame:
    """``rows`` with ``idx``: lines before their split and in front of them in it."""
    sizes = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min(line).alias("_first"))
    offsets = prefix_sums(sizes, split, "_n", "_before").drop("_n")
    placed = rows.join(broadcast_if_bounded(offsets, offsets.count()), split)
    idx = F.col("_before") + F.col(line) - F.col("_first")
    return placed.withColumn("idx", idx).drop(*split, line, "_first", "_before")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, idx`` of every line that is not blank; files are read twice."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    filled = lines.filter(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())
    return _with_idx(filled, ["_file", "_start"], "_line")


def load_in_order(
    spark: SparkSession, path: str, fmt: str | None = None, schema: Schema = CONVERSATION
) -> DataFrame:
    """Records as ``load_conversations`` reads them with ``idx``, their place in the data, from 0.

    ``schema`` is for JSON and may be None there: then it is found in a pass of its own.
    """
    fmt = format_of(path, fmt)
    if fmt == "parquet":
        rows = scan_parquet_dir(spark, path)
        kept = [c for c in rows.columns if c != "idx"]
        located = rows.select(
            *kept, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_line")
        )
        return _with_idx(located, ["_file"], "_line")
    if schema is None:
        plain = spark.read.option("multiLine", fmt == "json").option("mode", "FAILFAST")
        schema = plain.json(path).schema
    lines = scan_lines(spark, path) if fmt == "jsonl" else scan_array_records(spark, path)
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(record.alias("_r"), "idx").select("_r.*", "idx")
