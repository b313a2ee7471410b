"""Packing of tokenized documents into fixed-length sequences (operator 4).

Documents become pieces of at most ``capacity`` tokens. What is packed is the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus): a configuration linear program whose
columns are fillings of one sequence. Multiplicative weights set a price per length, a knapsack
dynamic program finds the filling of the highest price (a full one where there is one), and its share
grows until the lengths are covered evenly. Rounding down the shares leaves a few pieces of every
length; best fit, largest first, packs those, also into the room that fillings leave. Spark then
numbers the pieces of each length and deals them to the fillings.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.llm.common import returning, slices, stored
from dialoom.llm.token_counts import CACHED_CHARS, PATTERN, PairRanks, byte_letters, chunks

CAPACITY = 2048
ROUNDS = 1500  # of multiplicative weights: a bound for the driver's work
SHARE, SMALL = 0.9, 0.25  # of each length for the program, less of short ones: they fill gaps
CACHE = 600_000  # chunks kept by a task
GROUP_ROWS = 20_000  # pieces numbered by one task at once, about

LATIN = "\u0250"  # letters below are classed alike by every version of Unicode

Filling = tuple[tuple[int, int], ...]  # (length, how many)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; chunks already seen are looked up.

    Chunks that are new are encoded in long joined strings: no chunk holds a space beside its
    first character, so the ids whose token begins with a space are where chunks begin.

    Joined strings of Latin letters go to a second implementation of the same merges, which finds
    pairs by the bytes they make. Both agree wherever every token is what its own bytes encode to:
    two symbols that tile a token can then only be its own merge. ``exact_by_bytes`` tests this for
    the file; without it, and for all other letters, the tokenizer itself encodes.
    """

    JOINED = 4000

    def __init__(self, path: str, by_bytes: bool, cache: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache or CACHE
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True
        self.fast = self._by_bytes(path, vocab) if by_bytes else None
        self.known: dict[str, bytes] = {}

    def _by_bytes(self, path: str, vocab: dict[str, int]):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        letters = byte_letters()
        tokens = letters + ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        place = {c: b for b, c in enumerate(letters)}
        ranks = {bytes(map(place.__getitem__, t)): i for i, t in enumerate(tokens)}
        self.id_of_rank = np.array([vocab[t] for t in tokens], "<u4")
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split, odd, new = [], [], set()
        if len(self.known) > self.cache:
            self.known.clear()
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                odd.append((i, text))
                continue
            head, *rest = chunks(text)
            odd.append((i, head))
            split.append((i, rest))
            new.update(rest)
        new -= self.known.keys()
        plain = [c for c in new if " " not in c and (c.isascii() or max(c) < LATIN)]
        self.known.update(zip(plain, self._joined(plain)))
        rest = list(new.difference(plain))
        self.known.update(zip(rest, self._ids([" " + c for c in rest])))
        for (i, _), ids in zip(odd, self._ids([text for _, text in odd])):
            out[i] = ids
        for i, words in split:
            out[i] += b"".join(map(self.known.__getitem__, words))
        for c in new:
            if len(c) > CACHED_CHARS:
                del self.known[c]
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _joined(self, words: list[str]) -> list[bytes]:
        if self.fast is None:
            texts = [" " + " ".join(words[i : i + self.JOINED]) for i in range(0, len(words), self.JOINED)]
            data = b"".join(self._ids(texts))
        else:
            text = " " + " ".join(words) if words else ""
            data = self.id_of_rank[self.fast.encode_to_numpy(text, disallowed_special=())].tobytes()
        at = [*(4 * np.flatnonzero(self.begins[np.frombuffer(data, "<u4")])).tolist(), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:])]


def exact_by_bytes(path: str) -> bool:
    """Whether every token of the file is what the tokenizer makes of the token's own bytes."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    ranks, place = PairRanks(path), {c: b for b, c in enumerate(byte_letters())}
    spelled = [bytes(map(place.__getitem__, "".join(m if isinstance(m, list) else m.split(" ")))) for m in merges]
    return len({*spelled}) == len(spelled) and bool((ranks.merge_all(spelled) == 1).all())


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each row's ids and an end id 0, cut.

    A null text is empty: one piece with the end id alone. Only documents longer than ``capacity``
    are cut; all their pieces are full but the first. Repeated rows are packed as often as they
    come; other columns are ignored. ``cache``: chunks whose ids a task keeps.
    """

    by_bytes = exact_by_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path, by_bytes, cache)
        for batch in batches:
            for part in slices(batch):
                rows, made = [], []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for row, ids in enumerate(encoder.encode(texts)):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    start, end = 0, n - (-(-n // capacity) - 1) * capacity
                    piece = 0
                    while start < n:
                        rows.append(row)
                        made.append((piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                        start, end, piece = end, end + capacity, piece + 1
                values = list(zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(values[0], pa.int32())]
                    + [pa.array(v, pa.int64()) for v in values[1:]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(returning(run), f"doc_id {kind}, {PIECE}")


def best_filling(price: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: lengths (repeats allowed) of the highest total price that
    fill ``capacity`` exactly, or, if none do, that fit into it. Lengths without a price are left out."""
    best, choice = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, int)
    best[0] = 0
    price = np.where(price > 0, price, -np.inf)
    for room in range(1, capacity + 1):
        value = best[room - 1 :: -1] + price[1 : room + 1]
        at = int(value.argmax())
        best[room], choice[room] = value[at], at + 1
    filling, room = {}, capacity if best[capacity] > 0 else int(best.argmax())
    while room:
        length = int(choice[room])
        filling[length] = filling.get(length, 0) + 1
        room -= length
    return filling


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Filling, float]]:
    """Shares of fillings that use up every length at about the same rate.

    The weight of a length shrinks by a constant factor with each part of its pieces that is
    covered, so that what is left behind gets dearer; a price is the weight times the length,
    because the program's dual is close to the length itself.
    """
    counts = counts * np.minimum(SHARE, np.arange(len(counts)) / (SMALL * capacity))
    have = counts > 0
    covered = np.zeros(len(counts))
    size = np.arange(len(counts)) / capacity
    shares: dict[Filling, float] = {}
    for _ in range(rounds if have.any() else 0):
        weight = np.where(have & (covered < 1), np.exp(-0.5 * covered), 0)
        filling = best_filling(weight * size, capacity)
        if not filling:
            break
        lengths, used = np.array(list(filling)), np.array(list(filling.values()))
        room = (1 - covered[lengths]) * counts[lengths] / used
        step = float(room.min())
        covered[lengths] += step * used / counts[lengths]
        covered[lengths[covered[lengths] > 1 - 1e-9]] = 1
        key = tuple(sorted(filling.items(), reverse=True))
        shares[key] = shares.get(key, 0) + step
    return sorted(shares.items(), key=lambda x: -x[1])


def best_fit(counts: np.ndarray, capacity: int, begun: list[tuple[Filling, int]] = ()) -> list[tuple[Filling, int]]:
    """Best fit, largest first, over a histogram: equal sequences are handled together. ``begun``
    are sequences that hold something already."""
    open_: list[list[tuple[Filling, int]]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, bool)

    def put(room: int, filling: Filling, n: int) -> None:
        open_[room].append((filling, n))
        there[room] = True

    for filling, n in begun:
        put(capacity - sum(length * copies for length, copies in filling), filling, n)
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = int(there[length:].argmax()) + length
            if there[at]:
                filling, bins = open_[at].pop()
                there[at] = bool(open_[at])
            else:
                at, filling, bins = capacity, (), n
            copies = min(at // length, n)
            used = min(bins, n // copies)
            put(at - copies * length, (*filling, (length, copies)), used)
            if filling and used < bins:
                put(at, filling, bins - used)
            n -= used * copies
    return [x for room in open_ for x in room]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; together they hold exactly ``counts``.

    Rounded with and without the fillings that leave room: the fewer sequences win.
    """
    shares = fractional(counts, capacity)
    full = [(filling, share) for filling, share in shares if sum(k * a for k, a in filling) == capacity]
    plans = (_rounded(counts, capacity, x) for x in (shares, full))
    return min(plans, key=lambda fillings: sum(n for _, n in fillings))


def _rounded(counts: np.ndarray, capacity: int, shares: list[tuple[Filling, float]]) -> list[tuple[Filling, int]]:
    left, whole = counts.copy(), []
    for filling, share in shares:
        n = min(int(share + 1e-9), *(int(left[k]) // a for k, a in filling))
        if n:
            whole.append((filling, n))
            for length, a in filling:
                left[length] -= a * n
    return best_fit(left, capacity, whole)


def slots(fillings: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows ``length, first rank, copies, first sequence, offset``, by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for filling, n in fillings:
        offset = 0
        for length, copies in filling:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, copies, sequence, offset))
            next_rank[length], offset = rank + copies * n, offset + copies * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def rank_in_groups(df: DataFrame, group: str, salt: Column, order: list[Column], rank: str) -> DataFrame:
    """Gapless ranks from 0 within ``group``, numbered in salted parts with added offsets."""
    df = df.withColumn("_salt", salt)
    parts = df.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))
    ranked = df.withColumn("_place", place)
    joined = ranked.join(parts, (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(rank, F.col("_place") - 1 + F.col("_before")).drop(
        "_salt", "_g", "_s", "_place", "_before"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. An empty table gives an empty result."""
    pieces = stored(pieces)
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # <= capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["n"]
    places = slots(plan(counts, capacity))
    first = (places[:, 0] << 44) | places[:, 1]
    salts = 1 + int(counts.sum()) // GROUP_ROWS
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)) if salts > 1 else F.lit(0).cast("long")
    ranked = rank_in_groups(pieces, "length", salt, [F.col("doc_id"), F.col("piece")], "_rank")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            slot = places[np.searchsorted(first, (length << 44) | rank, "right") - 1]
            place = rank - slot[:, 1]
            columns = [*batch.columns[:-1], pa.array(slot[:, 3] + place // slot[:, 2])]
            columns.append(pa.array(slot[:, 4] + place % slot[:, 2] * length))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, F.col("_rank").cast("long").alias("_rank")).mapInArrow(returning(deal), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack(cut_pieces(docs, path, capacity, cache), capacity)
