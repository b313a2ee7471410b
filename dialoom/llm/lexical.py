"""Ranked lexical search by NRA over impact-sorted lists (operator 12).

1. One pass over the documents packs the terms that some query has: term numbers and frequencies by
   document, with the document's length, stored once in the shared folder. Counts of documents and
   terms, and the document frequencies of the queries' terms, are sums over that.
2. Documents stay where they are: a task turns its packed rows into segments of bounded size, each with
   one list per term sorted by impact. NRA reads the lists of a query in step, in growing blocks, and
   keeps for every document the sum of impacts read (lower bound) and what the unread rest of its
   other lists could add (upper bound). It stops when the best ``k`` are certain, ties included, and
   their scores are final. What a task has found before is a floor for its next segments.
3. Each task sends at most ``k`` rows per query, whatever its documents; these are ranked in Spark.

Queries are a stated set; they are taken in blocks of bounded size, one pass over the texts for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dialoom.llm.common import BATCH_ROWS, give_back, settings, slices, stored
from dialoom.session import fresh_path

TOP = 20
FIRST_READ = 64  # entries of each list read at first; every later read is twice as long
SEGMENT_ENTRIES = 1 << 21  # list entries in a segment, unless one packed row has more
SEGMENT_CELLS = 1 << 26  # lists of the longest query times documents of a segment
BLOCK_BYTES = 4 << 20  # text of queries handled in one pass
SALTS = 64
SCALE = 1_000_000_000

# ASCII characters that end a term become spaces, A-Z become lower case.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

PACKED = "ids binary, nulls binary, lengths binary, counts binary, terms binary, times binary, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, lengths: list[int], owner: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each entry adds to a score; ``weights`` by entry, ``lengths`` by document."""
    m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths], np.int64)
    return weights * ((SCALE * times) // (1000 * times + 12 * m[owner]))


def _pack(words: dict[bytes, int], most_docs: int):
    """Rows of packed entries, one per slice of text and ``most_docs`` documents; those without a
    term of any query count in ``n_docs`` and ``n_terms`` alone."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for start in range(0, part.num_rows, most_docs):
                    yield part.slice(start, most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n_docs = n_terms = 0
            ids, lengths, counts, terms, times = [], [], [], [], []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = terms_of(text or b"")
                n_docs, n_terms = n_docs + bool(found), n_terms + len(found)
                known = [(words[t], n) for t, n in Counter(found).items() if t in words]
                if known:
                    ids.append(i)
                    lengths.append(len(found))
                    counts.append(len(known))
                    terms.extend(t for t, _ in known)
                    times.extend(n for _, n in known)
            null = np.array([i is None for i in ids], bool)
            columns = [
                np.array([i or 0 for i in ids], "<i8"), null, np.array(lengths, "<i8"), np.array(counts, "<i8"),
                np.array(terms, "<u4"), np.array(times, "<u4"),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.array([n_docs]), pa.array([n_terms])],
                ["ids", "nulls", "lengths", "counts", "terms", "times", "n_docs", "n_terms"],
            )
        give_back()

    return run


def _document_frequencies(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                total += np.bincount(np.frombuffer(terms.as_buffer(), "<u4"), minlength=n_words)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    return run


class Segment:
    """Some documents with one list per term, sorted by falling impact."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        ids, nulls, lengths, counts, terms, times = (
            np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(("<i8", bool, "<i8", "<i8", "<u4", "<u4"))
        )
        self.ids, self.nulls = ids, nulls
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        impact = impacts(times.astype(np.int64), lengths.tolist(), owner, weights[terms], n_docs, n_terms)
        order = np.lexsort((-impact, terms))
        terms = terms[order]
        self.docs, self.impact = owner[order], impact[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(terms))
        self.lists = {t: (a, b) for t, a, b in zip(terms[first].tolist(), first.tolist(), ends.tolist())}

    def best(self, query: dict[int, int], k: int, floor: int = 1) -> list[tuple[int, int]]:
        """``(score, document)`` of the documents that can be among the best ``k`` and score at least
        ``floor``: the best ``k`` and all that tie with the last of them.

        ``query`` has the times of each term. Nothing is looked up by document: lists are read from
        the top, and a list is read on only while a document in question has not been met in it.
        """
        lists = [(*self.lists[t], n) for t, n in query.items() if t in self.lists]
        n = len(self.ids)
        if not lists or not n:
            return []
        lower = np.zeros(n, np.int64)
        unmet = np.ones((len(lists), n), bool)  # documents not met in a list so far
        at = [a for a, _, _ in lists]
        rest = np.array([self.impact[a] * times for a, _, times in lists], np.int64)  # most that a list still adds
        alive, step, wanted = np.arange(n), FIRST_READ, np.ones(len(lists), bool)
        while True:
            for j, (_, end, times) in enumerate(lists):
                if wanted[j]:
                    read = slice(at[j], min(at[j] + step, end))
                    docs = self.docs[read]
                    lower[docs] += self.impact[read] * times
                    unmet[j, docs] = False
                    at[j] = read.stop
                    rest[j] = self.impact[read.stop] * times if read.stop < end else 0
            step *= 2
            open_ = unmet[:, alive]
            low = lower[alive]
            high = low + rest @ open_
            # A document is out if it cannot reach the floor or the k-th best lower bound.
            least = floor
            if len(low) > k:
                least = max(least, int(np.partition(low, len(low) - k)[len(low) - k]))
            stay = high >= least
            alive, open_, low, high = alive[stay], open_[:, stay], low[stay], high[stay]
            wanted = (open_ & (low < high)).any(axis=1) & (rest > 0)
            if not wanted.any():  # all that are left are resolved
                return sorted(((int(s), int(d)) for s, d in zip(low, alive)), reverse=True)


def _rank_key(score: int, doc_id: int | None) -> tuple:
    return -score, doc_id is not None, doc_id or 0


def _search(queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, most_docs: int):
    """The best of each query among a task's documents: ``query, doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]

        def take(rows: list[tuple]) -> None:
            segment = Segment(rows, weights, n_docs, n_terms)
            for query, found in zip(queries, best):
                floor = -found[k - 1][0] if len(found) >= k else 1
                for score, d in segment.best(query, k, max(1, floor)):
                    found.append(_rank_key(score, None if segment.nulls[d] else int(segment.ids[d])))
                found.sort()
                del found[k:]

        rows, size, docs = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "nulls", "lengths", "counts", "terms", "times"))):
                here, entries = len(row[1]), len(row[4]) // 4
                if rows and (size + entries > SEGMENT_ENTRIES or docs + here > most_docs):
                    take(rows)
                    rows, size, docs = [], 0, 0
                rows.append(row)
                size, docs = size + entries, docs + here
        if rows:
            take(rows)
        made = [(q, i if known else None, -score) for q, found in enumerate(best) for score, known, i in found]
        columns = list(zip(*made)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])
        give_back()

    return run


def query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows of ``items`` (key, text as bytes) in blocks of bounded size, one in memory at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = bytes(row[1] or b"")
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text) + 16
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple], item_id: str, kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    words: dict[bytes, int] = {}
    queries = [Counter(words.setdefault(t, len(words)) for t in terms_of(text)) for _, text in block]
    most_docs = max(1, min(1 << 16, SEGMENT_CELLS // max(1, *map(len, queries))))
    place = fresh_path(spark, "postings")
    docs.mapInArrow(_pack(words, most_docs), PACKED).write.parquet(place)
    packed = spark.read.schema(PACKED).parquet(place)
    n_docs, n_terms = (n or 0 for n in packed.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(words) + 1, np.int64)
    with settings(spark, {BATCH_ROWS: "8"}):  # packed rows are wide
        counted = packed.select("terms").mapInArrow(_document_frequencies(len(words) + 1), "term long, df long")
        found = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # <= words of the block
    for term, df in zip(*(found.column(c).to_pylist() for c in ("term", "df"))):
        weights[term] = weight(n_docs, df)
    lists = packed.select("ids", "nulls", "lengths", "counts", "terms", "times")
    local = lists.mapInArrow(_search(queries, weights, n_docs, n_terms, k, most_docs), "query long, doc_id long, score long")
    # Twice the same ranking, so that no task takes the rows of all others for one query.
    salted = local.withColumn("salt", F.spark_partition_id() % SALTS)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    rank = F.row_number()
    few = salted.withColumn("rank", rank.over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    best = few.withColumn("rank", rank.over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, key) for q, (key, _) in enumerate(block)], f"query long, key {kind}")
    ranked = best.join(F.broadcast(names), "query").select(F.col("key").alias(item_id), "rank", "doc_id", "score")
    with settings(spark, {BATCH_ROWS: "8"}):
        return stored(ranked, 8)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for every row of ``items``.

    Scores are integers above 0: weight times saturated frequency, summed over the item's terms with
    repeats. Equal scores go by ascending ``doc_id``, null ids first; repeated rows are documents of
    their own. Ids are integers. Null texts have no terms: such a document is never found and does
    not count, such an item finds nothing. Rows of ``items`` that share an id are searched one by
    one. Other columns are ignored. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = dict(items.dtypes)[item_id]
    asked = items.select(F.col(item_id), F.col("text").cast("binary"))
    found = [_search_block(rows, block, item_id, kind, k) for block in query_blocks(asked)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"{item_id} {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
