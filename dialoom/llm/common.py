"""Shared helpers: reading a table, cutting Arrow batches, words, the check of a broadcast."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoom.session import freeze

# Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_CHARS = " \t\n\x0b\x0c\r"
LOWER_AZ = {i: i + 32 for i in range(65, 91)}

# Text handled at once by a Python worker, whatever Spark's batches are.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``most`` bytes of ``column``; one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        n = n or 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory of a Python worker to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; when it ends, its tables and caches go back to the machine, as
    the worker waits for tasks of other stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def utf8_bytes(text: Column) -> Column:
    """Length in bytes; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def part_count(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` rows: the session's number at least, more beyond ``per_part``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-rows // per_part))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session under other settings for one execution; its own hold again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, batch_rows: int = 1000) -> DataFrame:
    """``df`` checkpointed in the shared folder, without the shuffle files that led to it.

    Rows travel to Python ``batch_rows`` at a time, as a batch of wide rows counts several times
    in a task's memory.
    """
    with settings(df.sparkSession, {FREE_SHUFFLES: "true", BATCH_ROWS: str(batch_rows)}):
        return freeze(df.select("*"))


KEY_BITS = 26  # of the largest bitmap of keys, 8 MB in 2 ** 20 words: a bound


def with_may_match(df: DataFrame, key: Column, keys: Column, of: DataFrame, flag: str) -> DataFrame:
    """``df`` and a column ``flag``, false only where ``key`` is none of the ``keys`` of ``of``.

    Both are hashes of 64 bits. Their first bits are a place in a bitmap, which is sent everywhere
    and holds 32 places for a key until it has ``2 ** KEY_BITS``; so rows that no join can need stay
    where they are, and beyond that some more travel in vain.
    """
    bits = min(KEY_BITS, max(7, (32 * of.count()).bit_length()))
    word = lambda k: F.shiftrightunsigned(k, 70 - bits)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 64 - bits).bitwiseAND(63).cast("int"))
    words = of.groupBy(word(keys).alias("_key_word")).agg(F.bit_or(bit(keys)).alias("_key_bits"))
    joined = df.join(F.broadcast(words), word(key) == F.col("_key_word"), "left")
    found = F.coalesce(F.col("_key_bits").bitwiseAND(bit(key)) != 0, F.lit(False))
    return joined.select(*df.columns, found.alias(flag))
