"""Session-level helpers: the shared work folder and the broadcast bound."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when its row count is bounded by a parameter at or below this.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A session that names none gets a folder of its own under ``spark.sql.warehouse.dir``, and that
    becomes its checkpoint folder; on a cluster only if other machines can reach it.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    current = own_folder(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"))
    spark.sparkContext.setCheckpointDir(current)
    return current


def own_folder(master: str, warehouse: str) -> str:
    """A new folder under ``warehouse``. One of a single machine is refused unless all runs there."""
    if not master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError(f"name a shared folder in spark.checkpoint.dir: executors of {master} cannot read {warehouse}")
    return f"{warehouse.rstrip('/')}/_dialoom-{uuid.uuid4().hex}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so later steps see the same rows."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def broadcast_if_bounded(df: DataFrame, rows_bound: int | None) -> DataFrame:
    """Broadcast ``df`` only when the caller can state a small enough row bound.

    Without a bound the join strategy is left to Spark's own size estimates.
    """
    if rows_bound is not None and rows_bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df
