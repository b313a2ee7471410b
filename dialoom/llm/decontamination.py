"""Benchmark decontamination by pigeonhole edit matching (operator 10).

A text that contains a benchmark item with at most ``e`` edits contains one of any ``e + 1``
pieces of the item unchanged. One automaton over the pieces of all items finds these in a single
pass; the surroundings of each hit are verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.common import give_back, returning, slices

ERROR_RATE = 0.08  # edits per character of an item
MIN_CHARS = 20  # normalized; shorter items are sought without edits
BLOCK_CHARS = 2 << 20  # items matched in one pass over the documents


def normalize(text: str) -> str:
    """Lower case, white space collapsed."""
    return " ".join(text.lower().split())


def budget(item: str) -> int:
    return int(ERROR_RATE * len(item)) if len(item) >= MIN_CHARS else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their places."""
    n = budget(item) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of ``text``, and where that ends."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | minus
        diagonal = (((same & plus) + plus) ^ plus) | same
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i
        up, down = (up << 1) & full, (down << 1) & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
    return best, end


@dataclass
class Items:
    """A block of items, small enough to travel with a task."""

    ids: list
    texts: list[str]

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, items: Items) -> None:
        import ahocorasick

        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(items.texts):
            for at, piece in pieces(text):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def matches(self, text: str, first: bool = False) -> list[tuple[int, int]]:
        """(item, least distance) for each item within its budget; with ``first`` one is enough."""
        if not self.items.texts or not text:
            return []
        text = normalize(text)
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                start, slack = end + 1 - size - at, budget(self.items.texts[k])
                lo, hi = max(0, start - slack), start + len(self.items.texts[k]) + slack
                own = spans.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        found = []
        for k, own in sorted(spans.items()):
            item = self.items.texts[k]
            if item in text:
                distance = 0
            else:
                masks = self.masks.setdefault(k, masks_of(item))
                distance = min(myers(masks, len(item), text[lo:hi])[0] for lo, hi in own)
            if distance <= budget(item):
                found.append((k, distance))
                if first:
                    break
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """All items with any text, in blocks of about ``BLOCK_CHARS`` characters.

    Rows stream to the driver one partition at a time; a block is what one pass is sent.
    """
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        text = normalize(row["text"])
        if not text:
            continue
        if texts and size + len(text) > BLOCK_CHARS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += len(text)
    yield Items(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance``: a row for each row of ``docs`` and item that it contains.

    Null and empty texts contain nothing; items without text are in nothing. Items with equal text
    are all reported, repeated documents each report. Null ids are carried along.
    """
    id_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    out = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            matcher = items.matcher()
            for batch in batches:
                for part in slices(batch):
                    rows, found = [], []
                    for row, text in enumerate(part.column("text").to_pylist()):
                        for match in matcher.matches(text or ""):
                            rows.append(row)
                            found.append(match)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(rows, pa.int64())),
                            pa.array([items.ids[k] for k, _ in found], item_type),
                            pa.array([d for _, d in found], pa.int64()),
                        ],
                        ["doc_id", "item_id", "distance"],
                    )

        made = docs.select("doc_id", "text").mapInArrow(returning(run), f"doc_id {id_kind}, item_id {item_kind}, distance long")
        out = made if out is None else out.unionAll(made)
    return out


def is_leak(text: Column, items: Items) -> Column:
    """Whether a text contains an item of the block."""

    @F.arrow_udf("boolean")
    def leak(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = items.matcher()
        for texts in batches:
            yield pa.array([bool(matcher.matches(t.as_py() or "", first=True)) for t in texts], pa.bool_())
        del matcher
        give_back()

    return leak(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, whose text contains no item."""
    for items in item_blocks(benchmark):
        docs = docs.filter(~is_leak(F.col("text"), items))
    return docs
