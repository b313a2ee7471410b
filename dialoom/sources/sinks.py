"""Writers: JSON lines, batches by index range, their merge, and cached vocabularies."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from dialoom.schema import CONVERSATION


BATCH_FILE_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line with null fields spelled out; a folder of part files."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def batch_start(idx: Column, batch_save: int, start_index: int = 0) -> Column:
    """First index of the batch that ``idx`` falls into."""
    if batch_save < 1:
        raise ValueError("batch_save must be at least 1")
    return (F.floor((idx - start_index) / batch_save) * batch_save + start_index).cast("bigint")


def assign_batches(df: DataFrame, batch_save: int, start_index: int = 0) -> DataFrame:
    return df.withColumn("batch_start", batch_start(F.col("idx"), batch_save, start_index))


def write_batches(
    df: DataFrame, path: str, batch_save: int, start_index: int = 0, mode: str = "errorifexists"
) -> None:
    """Rows with an ``idx`` to disjoint batches: JSON lines that carry their ``batch_start``.

    A batch lies in one file, or in several of consecutive indexes if it is large. The layout is
    the same for any number of batches; several saves to one path add up. ``df`` is computed once:
    no sampling looks at it first, as its rows may come from a paid service.
    """
    batches = assign_batches(df, batch_save, start_index)
    piece = F.floor(F.col("idx") / BATCH_FILE_ROWS)
    dealt = batches.repartition("batch_start", piece).sortWithinPartitions("batch_start", "idx")
    writer = dealt.write
    writer.mode(mode).option("ignoreNullFields", False).json(path)


def scan_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batches as written, with attempts and errors where the save had them."""
    schema = T.StructType(
        [
            *CONVERSATION.fields,
            T.StructField("idx", T.LongType()),
            T.StructField("batch_start", T.LongType()),
            T.StructField("attempts", T.ArrayType(T.IntegerType())),
            T.StructField("errors", T.ArrayType(T.StringType())),
        ]
    )
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def merge_batches(batches: DataFrame, dedupe: str | None = "idx") -> DataFrame:
    """All batches in order of start and index.

    Saves that overlap repeat an ``idx``: of its rows the one with the fewest failed replies
    stays, then the latest batch's, then the one with the greatest digest, so the choice does not
    depend on the order of files. Winners are found on narrow rows that are combined before the
    shuffle. ``dedupe=None`` keeps all rows, as do rows without a key.
    """
    if dedupe is not None:
        failed = F.lit(0)
        if "errors" in batches.columns:
            failed = F.coalesce(F.size(F.array_compact("errors")), F.lit(0))
        digest = F.md5(F.to_json(F.struct(*sorted(batches.columns))))
        standing = F.struct((-failed).alias("f"), F.col("batch_start").alias("b"), digest.alias("d"))
        keyed = batches.filter(F.col(dedupe).isNotNull()).withColumn("_standing", standing)
        winners = keyed.groupBy(dedupe).agg(F.max("_standing").alias("_standing"))
        key = [dedupe, "_standing"]
        kept = keyed.dropDuplicates(key).join(winners, key, "left_semi").drop("_standing")
        batches = kept.unionByName(batches.filter(F.col(dedupe).isNull()))
    return batches.orderBy("batch_start", "idx")


class StageCounts:
    """Row counts taken while frames are written: no scan of their own.

    ``watch`` a frame at a stage, write what comes of it, then ask for the ``table``. A stage that
    no finished action has run through makes ``table`` wait.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.stages = spark, []

    def watch(self, df: DataFrame, **stages: Column) -> DataFrame:
        """``df``, with the rows counted for which each stage's condition holds."""
        seen = Observation(f"stage-{len(self.stages)}-{'-'.join(stages)}")
        self.stages.append(seen)
        return df.observe(seen, *[F.count_if(rows).alias(name) for name, rows in stages.items()])

    def table(self) -> DataFrame:
        """``stage, records``, in the order in which the stages were named."""
        rows = [(name, n) for seen in self.stages for name, n in seen.get.items()]
        return self.spark.createDataFrame(rows, "stage string, records bigint")


def record_counts(**stages: DataFrame) -> DataFrame:
    """Row count of each named stage as ``stage, records``; a scan each (``StageCounts`` has none)."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("stage"), "records")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def fingerprint(**parameters: object) -> str:
    """Short digest of everything a cached result depends on."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def data_state(df: DataFrame) -> list[list[str]]:
    """Names, sizes and times of the files behind a frame, for ``load_or_build_vocab``."""
    file = F.col("_metadata")
    files = df.select(
        file["file_path"].alias("path"), file["file_size"].cast("string").alias("size"),
        file["file_modification_time"].cast("string").alias("time"),
    ).distinct()
    # Only a digest comes back, whatever the number of files.
    row = F.md5(F.concat_ws("|", "path", "size", "time"))
    digest = files.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("d"))
    return [[str(v) for v in digest.agg(F.count("*"), F.sum("d")).first()]]


def load_or_build_vocab(
    spark: SparkSession, root: str, build: Callable[[], DataFrame], **parameters: object
) -> DataFrame:
    """The vocabulary saved for these parameters, built and saved first if there is none.

    Only a folder whose write finished counts as saved. Parameters must tell apart whatever may
    change: for data at a path, ``data_state`` of its frame rather than the path.
    """
    path = f"{root.rstrip('/')}/vocab-{fingerprint(**parameters)}"
    try:
        done = spark.read.text(f"{path}/_SUCCESS").schema is not None
    except AnalysisException:
        done = False
    if not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
