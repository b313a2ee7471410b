"""Merkle manifest of a table: subtrees by language, one root, a proof for every row (operator 13).

Time-forward processing. A node is labelled by its group, its level and its place; its digest is a
message to its parent. An external priority queue ordered by label hands out messages: between
blocks it is Spark's sort of messages by the block they are for, inside a block (256 neighbouring
nodes and the 8 levels above them) a heap. Every round lifts all groups by 8 levels, so its output
is a 256th of its input. A second, reversed sweep goes down the same rounds: each block gets the
suffix of the proofs that end in it as the first message, and passes longer ones on to its nodes.

What is shuffled is a few digests a row; texts are read once and never move.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.common import give_back, part_count
from dialoom.operators.ranking import places
from dialoom.session import freeze

BLOCK_LEVELS = 8
PART_ROWS = 500_000  # messages that one task handles, about
HEX = 64
# Labels of the nodes of a block: level above, place below.
WIDTH = 1 << 32

NODES = "grp string, at long, digest string, n long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int, block_levels: int) -> int:
    """Levels that a block of a run of ``n`` nodes is lifted by: fewer if the run ends in one."""
    return min(block_levels, (n - 1).bit_length())


def forward(digests: list[str], levels: int) -> dict[int, str]:
    """Digests of all nodes above (and of) a block's lowest ones, by label.

    The queue delivers what was sent to the node with the least label; the messages of two
    siblings come one after the other and make up their parent's digest.
    """
    queue = list(enumerate(digests))  # in order, so a heap
    known = dict(queue)
    while True:
        label, digest = heapq.heappop(queue)
        level, place = divmod(label, WIDTH)
        if level == levels:
            return known
        if queue and place % 2 == 0 and queue[0][0] == label + 1:
            digest += heapq.heappop(queue)[1]
        parent = (level + 1) * WIDTH + place // 2
        known[parent] = sha(digest)
        heapq.heappush(queue, (parent, known[parent]))


def backward(known: dict[int, str], levels: int, suffix: str) -> list[str]:
    """Proofs of a block's lowest nodes: one step a level, then ``suffix``.

    A step is ``L`` or ``R`` and the digest of the sibling on that side, or a dot without one.
    """
    queue, out = [(-levels * WIDTH, suffix)], []
    while queue:
        label, proof = heapq.heappop(queue)
        level, place = divmod(-label, WIDTH)
        if level == 0:
            out.append(proof)
            continue
        left = (level - 1) * WIDTH + 2 * place
        right = known.get(left + 1)
        heapq.heappush(queue, (-left, (f"R{right}" if right else ".") + proof))
        if right:
            heapq.heappush(queue, (-left - 1, f"L{known[left]}{proof}"))
    return out[::-1]


def siblings(proof: str) -> str:
    return proof.replace("L", "").replace("R", "").replace(".", "")


def fold(digest: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    while at < len(proof):
        step, other = proof[at], proof[at + 1 : at + 1 + HEX]
        if step == ".":
            digest, at = sha(digest), at + 1
        else:
            digest, at = sha(digest + other if step == "R" else other + digest), at + 1 + HEX
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one block after the other; the first two columns name the block."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, block in groupby(rows, itemgetter(0, 1)):
        yield key, list(block)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    ready = []
    for row in rows:
        ready.append(row)
        if len(ready) == most:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*ready), schema)], schema=schema)
            ready = []
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*ready), schema)], schema=schema)


NODE_FIELDS = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
SUFFIXES = "grp string, at long, proof string, subroot string, root string"
SUFFIX_FIELDS = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("proof", pa.string()), ("subroot", pa.string()), ("root", pa.string())])


def _rise(block_levels: int):
    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (group, block), rows in _blocks(batches):
            n = rows[0][4]
            levels = levels_of(n, block_levels)
            known = forward([r[3] for r in rows], levels)
            yield group, block, known[levels * WIDTH], -(-n >> levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(lifted(batches), NODE_FIELDS)
        give_back()

    return run


def _dealt(messages: DataFrame, rows: int) -> DataFrame:
    """Messages sorted by the block they are for, blocks spread over tasks."""
    return messages.repartition(part_count(messages, rows, PART_ROWS), "grp", "block").sortWithinPartitions("grp", "block", "at")


def climb(nodes: DataFrame, longest: int, rows: int, block_levels: int) -> list[DataFrame]:
    """``nodes`` and the nodes after each round (stored), the last with one node per group."""
    rounds = [nodes]
    for _ in range(max(1, -(-(longest - 1).bit_length() // block_levels))):
        block = F.shiftright("at", block_levels).alias("block")
        messages = rounds[-1].select("grp", block, "at", "digest", "n")
        rounds.append(freeze(_dealt(messages, rows).mapInArrow(_rise(block_levels), NODES)))
        rows = max(1, rows >> block_levels)
    return rounds


def _to_blocks(nodes: DataFrame, suffixes: DataFrame, block_levels: int, rows: int, more: list[str]) -> DataFrame:
    """Nodes of a round and, in front of each block, the proof suffix that reached it."""
    text = F.lit(None).cast("string")
    lower = nodes.select(
        "grp", F.shiftright("at", block_levels).alias("block"), "at", "digest", "n",
        *[text.alias(c) for c in ("proof", "subroot", "root")], *more,
    )
    kinds = dict(nodes.dtypes)
    upper = suffixes.select(
        "grp", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), text.alias("digest"),
        F.lit(None).cast("long").alias("n"), "proof", "subroot", "root",
        *[F.lit(None).cast(kinds[c]).alias(c) for c in more],
    )
    return _dealt(lower.unionAll(upper), rows)


def _proofs(batches: Iterator[pa.RecordBatch], block_levels: int) -> Iterator[tuple[tuple, tuple, str]]:
    """Each node's row, the message that came to its block, and its proof."""
    for _, (message, *rows) in _blocks(batches):
        levels = levels_of(rows[0][4], block_levels)
        known = forward([r[3] for r in rows], levels)
        for row, proof in zip(rows, backward(known, levels, message[5])):
            yield row, message, proof


def _sink(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row[0], row[2], proof, m[6], m[7]) for row, m, proof in _proofs(batches, block_levels))
        yield from _batches(made, SUFFIX_FIELDS)
        give_back()

    return run


def _verify(block_levels: int):
    """Proofs reach the leaves: the manifest's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        text, whole = pa.string(), first.schema.field("doc_id").type
        fields = pa.schema([("doc_id", whole), *[(c, text) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def made() -> Iterator[tuple]:
            for row, (*_, subroot, root, _, _), proof in _proofs(every(), block_levels):
                *_, doc_id, altered = row
                folded = fold(altered or row[3], proof)
                yield doc_id, row[3], subroot, root, sha(siblings(proof)), folded, folded == root

        yield from _batches(made(), fields)
        give_back()

    return run


def descend(rounds: list[DataFrame], suffixes: DataFrame, rows: int, block_levels: int) -> DataFrame:
    """Proof suffixes of the lowest nodes but one round: ``rounds[0]`` is left to the caller."""
    for step in range(len(rounds) - 2, 0, -1):
        here = max(1, rows >> (block_levels * step))
        messages = _to_blocks(rounds[step], suffixes, block_levels, here, [])
        suffixes = messages.mapInArrow(_sink(block_levels), SUFFIXES)
    return suffixes


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, grp, digest, altered``: the leaf of each row, and another where it is tampered with.

    A field is ``-`` if null, else its bytes in UTF-8, a colon and its value. Tampering adds 1 to
    ``n_chars``; a null one stays.
    """

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def digest(n_chars: Column) -> Column:
        fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
        return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)

    changed = F.when(tampered & F.col("n_chars").isNotNull(), digest(F.col("n_chars").cast("decimal(38,0)") + 1))
    return docs.select("doc_id", F.col("lang").alias("grp"), digest(F.col("n_chars")).alias("digest"), changed.alias("altered"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    Leaves are those of ``doc_id, source, lang, n_chars, text``; other columns are ignored. Leaves
    of a language ascend by ``doc_id``, then by digest (rows equal in all five come in any order,
    and each has a proof of its own). Null ids come first, a null language is a language, null and
    empty values differ. ``tampered`` (nothing by default) says which rows are changed before they
    are checked: their ``folded_root`` is not the root. An empty table gives no rows.
    """
    if tampered is None:
        tampered = F.lit(False)
    found = leaves(docs, tampered).withColumn("_copy", F.monotonically_increasing_id())
    placed = places(found, ["doc_id", "digest", "_copy"], ["grp"])
    placed = placed.select("doc_id", "grp", F.col("place").alias("at"), "digest", F.col("n_rows").alias("n"), "altered")
    longest, rows = placed.agg(F.max("n"), F.count(F.lit(1))).first()
    rounds = climb(placed.select("grp", "at", "digest", "n", "doc_id", "altered"), longest or 1, rows, block_levels)

    subroots = rounds[-1].select("grp", "digest")
    above = places(subroots, ["grp"]).select(
        F.lit("").alias("grp"), F.col("place").alias("at"), "digest", F.col("n_rows").alias("n"), F.col("grp").alias("lang")
    )
    languages = above.agg(F.max("n")).first()[0] or 1
    upper = climb(above, languages, languages, block_levels)
    top = upper[-1].select("grp", "at", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    reached = descend(upper, top, languages, block_levels)
    # The lowest round of the upper tree hands its proofs to the subroots of the lower ones.
    messages = _to_blocks(above, reached, block_levels, languages, ["lang"])

    def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row[8], 0, proof, row[3], m[7]) for row, m, proof in _proofs(batches, block_levels))
        yield from _batches(made, SUFFIX_FIELDS)

    suffixes = messages.mapInArrow(hand_over, SUFFIXES)
    suffixes = descend(rounds, suffixes, rows, block_levels)
    messages = _to_blocks(rounds[0], suffixes, block_levels, rows, ["doc_id", "altered"])
    kind = dict(docs.dtypes)["doc_id"]
    return messages.mapInArrow(
        _verify(block_levels),
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
