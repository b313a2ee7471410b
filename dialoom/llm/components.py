"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import returning, stored


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Edges (larger, root) of a forest with the same components; roots are the least nodes."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def thinned(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` with those inside a batch replaced by a forest: linear in its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], ["a", "b"]
            )

    return edges.select("a", "b").mapInArrow(returning(run), "a long, b long")


def components(edges: DataFrame, batch_rows: int = 1000) -> DataFrame:
    """``node, component`` for nodes ``a, b`` (long) of at least one edge; component: least node.

    Large stars tie each node's greater neighbours to its least one, small stars the lesser ones;
    both only ever shrink labels. It ends when a round changes nothing. Hot nodes are pre-aggregated,
    and the joins on them are ordinary ones that adaptive execution can split. What makes ``edges``
    gets ``batch_rows`` rows at a time.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(thinned(edges).filter("a != b").select(high.alias("a"), low.alias("b")).distinct(), batch_rows)

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while now != before:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small.unionAll(least.select("a", F.col("m").alias("b")))
        edges = stored(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, now = now, state(edges)
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
