"""Resharding by minimum-cost flow (operator 7).

Old shards supply bytes, new shards take as many as their capacity; bytes that stay cost nothing,
bytes that move cost one each. The flow that moves least says how many bytes go from each old shard
to each new one. Inside an old shard, items (texts with all their copies) lie along a line of bytes,
large ones first: what stays is taken from its head, transfers from the tail, where items are small
and cuts fall close to where the flow wants them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.llm.common import utf8_bytes
from dialoom.llm.packing import GROUP_ROWS, rank_in_groups
from dialoom.session import freeze

PARTS = 256  # an item that no shard can hold is split into parts of 1/PARTS of a shard


def least_transfers(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from old shard i to new shard j by successive shortest paths; staying costs 0.

    ``sum(capacity)`` must be at least ``sum(supply)``. Nodes are shards, not data.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    while any(left):
        # Bellman-Ford from all old shards with bytes left; new shards are nodes n, n + 1, ...
        cost = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    price = int(i != j)
                    if cost[i] is not None and (cost[n + j] is None or cost[i] + price < cost[n + j]):
                        cost[n + j], came[n + j], changed = cost[i] + price, i, True
                    if flow[i][j] and cost[n + j] is not None and (cost[i] is None or cost[n + j] - price < cost[i]):
                        cost[i], came[i], changed = cost[n + j] - price, n + j, True
        sink = min((j for j in range(m) if room[j] and cost[n + j] is not None), key=lambda j: (cost[n + j], j))
        path = [n + sink]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([left[path[0]], room[sink]] + [flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[sink] -= amount
    return flow


def _shard_at(old: Column, start: Column, flow: list[list[int]]) -> Column:
    """The new shard of an item whose middle is at ``start`` on its old shard's line."""
    out = F.lit(None).cast("int")
    for i, row in enumerate(flow):
        order = [i] * (i < len(row)) + [j for j in range(len(row)) if j != i]
        used = [j for j in order if row[j]] or order[:1]
        end, inner = sum(row[j] for j in used), F.lit(used[-1])
        for j in reversed(used[:-1]):
            end -= row[used[used.index(j) + 1]]
            inner = F.when(start < end, F.lit(j)).otherwise(inner)
        out = F.when(old == i, inner).otherwise(out)
    return out


def _line_places(items: DataFrame, n_items: int) -> DataFrame:
    """``items`` with the byte in the middle of each on its old shard's line."""
    salts = 1 + n_items // GROUP_ROWS
    items = items.withColumn("_class", -F.floor(F.log2(F.col("bytes").cast("double")) * 8).cast("int"))
    items = items.withColumn("_salt", F.pmod(F.xxhash64("key", "part"), F.lit(salts)).cast("int"))
    blocks = items.groupBy("old", "_class", "_salt").agg(F.sum("bytes").alias("_all"))
    line = Window.partitionBy("old").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("old", "_class", "_salt", F.coalesce(F.sum("_all").over(line), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("old", "_class", "_salt").orderBy(F.desc("bytes"), "key", "part")
    inside = F.sum("bytes").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    placed = items.withColumn("_inside", inside).join(blocks, ["old", "_class", "_salt"])
    return placed.select("old", "key", "part", (F.col("_before") + F.col("_inside") + F.col("bytes") / 2).alias("start"))


def _keyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with their id as ``_id`` and ``_null``, which joins without losing null ids."""
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return rows.withColumn("_id", F.coalesce("doc_id", zero)).withColumn("_null", F.col("doc_id").isNull())


def reshard(docs: DataFrame, old: Column, old_shards: int, capacities: list[float]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, ``old_shard`` and ``row`` per row.

    ``old``: the present shard (0 .. ``old_shards`` - 1) of a row; ``capacities``: relative sizes of
    the new shards. Law ``bytes``: sizes follow the capacities, off by no more than the items at
    the cuts. Copies of a text that share an old shard stay together unless they exceed the smallest
    new shard. A null text is empty; its size is 1. Null ids and repeated rows are placed like
    others. ``slot`` numbers a shard's rows without gaps; ``grown_shard`` is null for this law.
    ``row`` holds all columns of ``docs``; a plan that does not use it does not shuffle it. Rows are
    read again for it, so ``docs`` and ``old`` must give the same rows each time.
    """
    text = F.col("text")
    whole = docs.select(
        "doc_id",
        (utf8_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        old.cast("int").alias("old"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    base = freeze(whole.drop("row"))
    supply = [0] * old_shards
    for r in base.groupBy("old").agg(F.sum("size").alias("n")).collect():  # one row per old shard
        supply[r["old"]] = r["n"]
    total, weight = sum(supply), sum(capacities)
    edges = [round(total * sum(capacities[:j]) / weight) for j in range(len(capacities) + 1)]
    flow = least_transfers(supply, [b - a for a, b in zip(edges, edges[1:])])
    holds = min((b - a for a, b in zip(edges, edges[1:]) if b > a), default=1)
    piece = max(1, holds // PARTS)
    large = (
        base.groupBy("old", "key").agg(F.sum("size").alias("n")).filter(F.col("n") > holds)
        .select("old", "key", F.ceil(F.col("n") / piece).cast("int").alias("parts"))
    )
    large = freeze(large)
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")

    def in_parts(rows: DataFrame) -> DataFrame:
        # At most total / holds rows, a number that the shards fix.
        rows = rows.join(F.broadcast(large), ["old", "key"], "left")
        return rows.withColumn("part", part).drop("parts")

    items = freeze(in_parts(base).groupBy("old", "key", "part").agg(F.sum("size").alias("bytes")))
    placed = _line_places(items, items.count()).withColumn("shard", _shard_at(F.col("old"), F.col("start"), flow))
    placed = freeze(placed.drop("start"))
    rows = in_parts(base).join(placed, ["old", "key", "part"])
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 + base.count() // GROUP_ROWS))
    order = [F.col(c) for c in ("doc_id", "text_crc32", "key", "old")]
    ranked = rank_in_groups(rows, "shard", salt, order, "slot")
    # Rows that agree in id, text and old shard have one new shard and slots that follow each other.
    keys = ["_id", "_null", "key", "old"]
    spots = freeze(_keyed(ranked, docs).groupBy(*keys).agg(F.min("shard").alias("shard"), F.min("slot").alias("_first")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("text_crc32"))
    found = _keyed(whole, docs).join(spots, keys).withColumn("slot", F.col("_first") + nth - 1)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
        "row",
    )


def _free_name(name: str, taken: set[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that lose or gain rows as ``path/shard=<n>``; returns their numbers.

    Shards that keep just the rows they had stay as they are. Rows come from ``placed`` itself and
    nothing is looked up by id: null ids, repeated ids and repeated rows are written as often as they
    were placed. Files hold the columns of ``docs`` and the slot; ``shard`` and ``slot`` get
    underscores in front where the table has columns of these names. Rows of a shard
    are spread over all tasks, so that rows are shuffled once.
    """
    moved = placed.filter(F.col("shard") != F.col("old_shard"))
    sides = moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect()  # shards
    affected = sorted(r["s"] for r in sides)
    taken = {c.lower() for c in docs.columns}
    shard, slot = (_free_name(name, taken) for name in ("shard", "slot"))
    rows = placed.filter(F.col("shard").isin(affected)).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows.write.mode("overwrite").partitionBy(shard).parquet(path)
    return affected
