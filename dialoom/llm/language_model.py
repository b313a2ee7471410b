"""Stupid-backoff scores, summed per document (operator 2).

Words are the ids of a public tokenizer. Texts are tokenized once; a slice of documents (a few MB of
text) is stored as one row of ids.

1. Bigrams of every slice, each with its number, are rows of a table; grouped by bigram, with
   partial sums in each task, they give the count table, partitioned by hash.
2. Joined back to it by bigram, every slice learns the counts of its own bigrams. Totals by context
   and by token have at most a row per token of the vocabulary and are sent everywhere.
3. These rows and the stored ids meet by slice, where documents are scored one slice at a time and
   each document's log scores are summed.

A frequent bigram or context is one row per slice at most, whatever its documents.

A bigram counts as seen only if another document has it, so no document vouches for itself:
S(w | u) = c'(u, w) / c'(u) if c'(u, w) > 0, else ALPHA * c(w) / N, with c' without the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import BATCH_ROWS, SLICE_BYTES, give_back, part_count, settings, stored
from dialoom.llm.packing import Encoder, exact_by_bytes
from dialoom.session import fresh_path

ALPHA = 0.4
CACHE = 80_000  # chunks kept by a task
START = (1 << 31) - 1  # context of a text's first token; no id of a vocabulary reaches it
ROWS = 20_000  # bigrams in one Arrow batch
PART_GRAMS = 1_000_000  # bigram rows in one task, about
TEXT_ROWS = 300  # documents in one Arrow batch
SCORED_TOKENS = 100_000  # of a slice, scored at once; one document at least

SLICES = "ids binary, nulls binary, sizes binary, tokens binary"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of about ``most`` bytes of text, whatever the batches are; one row at least."""
    ids, texts, size = [], [], 0
    for batch in batches:
        columns = (batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
        for doc_id, text, n in zip(*columns, pa.compute.binary_length(batch.column("text")).to_pylist()):
            if texts and size + (n or 0) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text or "")
            size += n or 0
    if texts:
        yield ids, texts


def _tokenize(path: str, by_bytes: bool):
    """One row per slice: ids of its documents, their numbers of tokens, all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path, by_bytes, CACHE)
        for ids, texts in _gathered(batches, SLICE_BYTES):
            made = encoder.encode(texts)
            columns = [
                np.array([i or 0 for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids], bool).tobytes(),
                np.array([len(m) // 4 for m in made], "<i8").tobytes(),
                b"".join(made),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "nulls", "sizes", "tokens"])
        del encoder
        give_back()

    return run


def bigrams(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Each token below its context in one number; a text's first token follows ``START``."""
    right = tokens.astype(np.int64)
    left = np.append(START, right[:-1])
    left[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return left << 32 | right


def _send_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, sizes, tokens in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "tokens"))):
            gram, n = np.unique(bigrams(np.frombuffer(sizes, "<i8"), np.frombuffer(tokens, "<u4")), return_counts=True)
            for at in range(0, len(gram), ROWS):
                part = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram[part]), number)), pa.array(gram[part]), pa.array(n[part])], ["slice", "gram", "n"]
                )
    give_back()


class Totals:
    """Occurrences by context and by token, of at most one vocabulary."""

    def __init__(self, contexts: pa.Table, tokens: pa.Table) -> None:
        self.context, self.context_n = self._sorted(contexts)
        self.token, token_n = self._sorted(tokens)
        self.backed_off = np.log(ALPHA * token_n / max(1, token_n.sum()))

    @staticmethod
    def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n = table.column(0).to_numpy(), table.column(1).to_numpy()
        order = np.argsort(key)
        return key[order], n[order].astype(float)


def score_slice(sizes: np.ndarray, tokens: np.ndarray, seen: np.ndarray, count: np.ndarray, totals: Totals) -> np.ndarray:
    """Sum of log scores of each document; ``seen`` are the slice's bigrams in order, with counts."""
    ends = np.cumsum(sizes)
    # Some documents at a time: what is worked out for a token takes many times its own bytes.
    cuts = np.flatnonzero(np.diff((ends - sizes) // SCORED_TOKENS)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    sums = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own = tokens[ends[lo] - sizes[lo] : ends[hi - 1]] if hi > lo else tokens[:0]
        sums.append(_score_some(sizes[lo:hi], own, seen, count, totals))
    return np.concatenate(sums)


def _score_some(sizes: np.ndarray, tokens: np.ndarray, seen: np.ndarray, count: np.ndarray, totals: Totals) -> np.ndarray:
    if not len(tokens):
        return np.zeros(len(sizes))
    gram = bigrams(sizes, tokens)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.searchsorted(seen, gram)
    # Distinct bigrams of each document, by document and, as ``seen`` is in order, by context.
    code, times = np.unique(owner * len(seen) + place, return_counts=True)
    doc, place = np.divmod(code, len(seen))
    context = seen[place] >> 32
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (context[1:] != context[:-1])))
    own = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(doc))))  # c_d(u)
    others = count[place] - times
    log = totals.backed_off[np.searchsorted(totals.token, seen[place] & 0xFFFFFFFF)]
    hit = others > 0
    others_context = totals.context_n[np.searchsorted(totals.context, context[hit])] - own[hit]
    log[hit] = np.log(others[hit] / others_context)
    return np.bincount(doc, times * log, len(sizes))


def _score(totals: Totals):
    """Rows come by slice, its bigrams first, its documents last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = [], []
        for batch in batches:
            tokens = batch.column("tokens")
            gram, count = (batch.column(c).fill_null(0).to_numpy() for c in ("gram", "count"))
            start = 0
            for at in np.flatnonzero(tokens.is_valid().to_numpy(zero_copy_only=False)).tolist():
                grams.append(gram[start:at])
                counts.append(count[start:at])
                start = at + 1
                seen, order = np.unique(np.concatenate(grams), return_index=True)
                ids, nulls, sizes, data = (np.frombuffer(batch.column(c)[at].as_buffer(), k) for c, k in (("ids", "<i8"), ("nulls", bool), ("sizes", "<i8"), ("tokens", "<u4")))
                sums = score_slice(sizes, data, seen, np.concatenate(counts)[order], totals)
                grams, counts = [], []
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(sizes), pa.array(sums)], ["doc_id", "n_tokens", "log"])
            grams.append(gram[start:])
            counts.append(count[start:])
        give_back()

    return run


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` for each row of ``docs``.

    Counts are those of all rows; repeated rows count, and vouch for each other, as often as they
    come. Null and empty texts have 0 tokens, ``log_score`` 0 and a null mean. Null ids are scored
    like any other. Ids are integers. Scores are rounded to six digits; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = fresh_path(spark, "token-slices")
    with settings(spark, {BATCH_ROWS: str(TEXT_ROWS)}):
        made = rows.mapInArrow(_tokenize(path, exact_by_bytes(path)), SLICES)
        made.withColumn("slice", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(place)
    held = spark.read.schema(f"{SLICES}, slice long").parquet(place)
    place = fresh_path(spark, "bigrams")
    with settings(spark, {BATCH_ROWS: "1"}):  # wide rows
        held.select("slice", "sizes", "tokens").mapInArrow(_send_bigrams, "slice long, gram long, n long").write.parquet(place)
    grams = spark.read.schema("slice long, gram long, n long").parquet(place)

    counts = stored(grams.groupBy("gram").agg(F.sum("n").alias("count")))
    by = {"context": F.shiftright("gram", 32), "token": F.col("gram").bitwiseAND(0xFFFFFFFF)}
    sums = [counts.groupBy(key.alias(name)).agg(F.sum("count").alias("n")) for name, key in by.items()]
    totals = Totals(*(s.toArrow() for s in sums))  # at most a row per token of the vocabulary each

    known = grams.join(counts, "gram").select("slice", F.lit(0).alias("last"), "gram", "count")
    messages = known.unionByName(held.withColumn("last", F.lit(1)), allowMissingColumns=True)
    dealt = messages.repartition(part_count(docs, grams.count(), PART_GRAMS), "slice").sortWithinPartitions("slice", "last")
    scored = dealt.select("gram", "count", "ids", "nulls", "sizes", "tokens").mapInArrow(
        _score(totals), "doc_id long, n_tokens long, log double"
    )
    return scored.select(
        "doc_id",
        "n_tokens",
        F.round("log", 6).alias("log_score"),
        F.round(F.when(F.col("n_tokens") > 0, F.col("log") / F.col("n_tokens")), 6).alias("mean_log_score"),
    )
