"""Token counts by rank-synchronous merging of ragged arrays (operator 8).

A byte-level BPE turns a pre-token into bytes and then merges, again and again, all occurrences of
the adjacent pair with the lowest rank. Here all pre-tokens of a batch lie end to end in one numpy
array. Each round finds the lowest rank of *every* sequence by a segmented minimum and applies all
those merges at once; sequences without a mergeable pair leave, and the number of their surviving
symbols is their token count. A text is the sum over its pre-tokens.

Pre-tokens repeat, so a task keeps the counts of the chunks it has seen (bounded, then cleared).
No shuffle takes place.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import slices, utf8_bytes

NONE = np.int64(1) << 40  # no rank
LONG = 4096  # symbols beyond which one sequence is merged by a heap instead
CACHE = 300_000  # chunks kept by a task
CACHED_CHARS = 48

# Fixed value: the public split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A single space between two non-spaces always begins a pre-token, whatever surrounds it.
DOUBLE_SPACE = re.compile(r" \s|\s ")
SAFE_SPLIT = re.compile(r" (?<=\S )(?=\S)")


def chunks(text: str) -> list[str]:
    """``text`` cut before single spaces; all but the first chunk have lost their space."""
    if DOUBLE_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return SAFE_SPLIT.split(text)
    return text.split(" ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, others from 256 up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, other = [], 256
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(other))
        other += b not in printable
    return letters


class PairRanks:
    """Merges of a tokenizer file as sorted arrays: pair of ids -> rank, merged id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int64)
        rows = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rows.append(((vocab[a] << 32) | vocab[b], rank, vocab[a + b]))
        pairs = np.array(sorted(rows), np.int64)
        self.keys, self.ranks, self.merged = pairs[:, 0].copy(), pairs[:, 1].copy(), pairs[:, 2]
        self.by_pair = None
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NONE`` where a pair does not merge) and places in the table."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), at

    def merge_one(self, data: bytes) -> int:
        """Tokens of one very long sequence: a heap of pairs over a linked list."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (found := self.by_pair.get((ids[i] << 32) | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids)):
            push(i)
        left = len(ids)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i], left = merged, -1, after[j], left - 1
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return left

    def merge_all(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of every (non-empty) sequence, all merged round by round together."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        counts = np.ones(len(sequences), np.int64)
        for i in np.flatnonzero(lengths > LONG):
            counts[i] = self.merge_one(sequences[i])
        live = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        ids = self.byte_id[np.frombuffer(b"".join([sequences[i] for i in live]), np.uint8)]
        lengths = lengths[live]
        while len(live):
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(ids), NONE)
            rank[:-1], at = self.look_up(ids[:-1], ids[1:])
            rank[starts[1:] - 1] = NONE
            lowest = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < NONE))
            # Of overlapping pairs (a run of equal symbols) every second one, from the left.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[place % 2 == 0]
            ids[hit] = self.merged[at[hit]]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            sizes = np.add.reduceat(stays, starts, dtype=np.int64)
            over = (lowest == NONE) | (sizes == 1)
            counts[live[over]] = sizes[over]
            ids = ids[stays & ~np.repeat(over, lengths)]
            live, lengths = live[~over], sizes[~over]
        return counts


class Counter:
    """Token counts of texts, with a bounded memory of chunks."""

    def __init__(self, path: str) -> None:
        import regex

        self.table, self.pattern = PairRanks(path), regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        """Counts of new chunks into ``known``; each is merged once in a shared array."""
        pieces: dict[str, int] = {}
        made = [[pieces.setdefault(p, len(pieces)) for p in self.pattern.findall(c)] for c in new]
        counts = self.table.merge_all([p.encode() for p in pieces]) if pieces else np.zeros(0, int)
        for chunk, places in zip(new, made):
            self.known[chunk] = int(sum(counts[i] for i in places))

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts in which special strings have no meaning."""
        split = []
        for text in texts:
            head, *rest = chunks(text)
            split.append([head, *[" " + c for c in rest]] if text else [])
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn([c for c in {c for s in split for c in s} if c not in self.known])
        counts = [sum(map(self.known.__getitem__, s)) for s in split]
        for c in {c for s in split for c in s if len(c) > CACHED_CHARS}:
            self.known.pop(c, None)
        return counts

    def count(self, texts: list[str]) -> list[int]:
        special = self.table.special
        totals, at, parts = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if special is not None and special.search(text):
                totals[i] = len(special.findall(text))
                for part in special.split(text):
                    at.append(i)
                    parts.append(part)
            else:
                at.append(i)
                parts.append(text)
        for i, n in zip(at, self.plain(parts)):
            totals[i] += n
        return totals


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Counts equal those of the tokenizer file at ``path`` (byte-level BPE, no normalizer), without
    added tokens; strings of special tokens inside a text count one token each, which is that
    library's default. A null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and
    other columns are of no effect: every row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counter.count(texts), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    counted = docs.select("doc_id", "text", utf8_bytes(F.col("text")).alias("n_bytes")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
