"""Removal of repeated byte strings by sampled prefix doubling (operator 6).

Ranks are fingerprints: those of 8 bytes are the bytes, those of 16, 26, 32 and 50 bytes come from
pairs of shorter ones at growing offsets. Spark sorts and reranks, dropping what is unique:

1. Of the ranks at 26 bytes only those are sent that some 50-byte string needs: its least one (a
   sampled position). A position whose rank occurs in one document alone is dropped for good.
2. At the positions left, the 50-byte strings that share the sampled position form a run. Runs that
   agree as a whole (first and last string) need only the least document with that run.
3. Where runs with the same 26-byte rank differ, the 50-byte ranks themselves are sorted: that is
   past the threshold, and what is equal there is a repeat.

Records travel packed, a task's share of a rank bucket in one row. Buckets grow with the input.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import give_back, slices

LENGTH, GRAM = 50, 26
SPAN = LENGTH - GRAM + 1  # ranks at GRAM bytes inside one string
BUCKET_BYTES = 18 << 20  # of text that sends its ranks to one bucket
MIN_BUCKETS = 48
CHUNK = 1 << 19  # bytes ranked at once, unless one text is longer
U = np.uint64


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Ranks of joined strings from the ranks of their halves."""
    x = a * U(0x9E3779B97F4A7C15 + 2 * salt) + (b ^ (b >> U(31))) * U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def ranks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks at ``GRAM`` and at ``LENGTH`` bytes of every position that has as many."""
    h1 = np.frombuffer(data, np.uint8).astype(np.uint64)
    h2 = h1[:-1] | h1[1:] << U(8)
    h4 = h2[:-2] | h2[2:] << U(16)
    h8 = h4[:-4] | h4[4:] << U(32)
    h16 = _pair(h8[:-8], h8[8:], 1)
    gram = _pair(h16[:-10], h16[10:], 2)
    h32 = _pair(h16[:-16], h16[16:], 3)
    return gram, _pair(h32[:-18], h32[18:], 4)


def sampled(gram: np.ndarray, windows: int) -> np.ndarray:
    """For each string the position of its least rank, the leftmost of equals."""
    step = 1 << 25  # positions fit beside the ranks
    out = np.empty(windows, np.int64)
    for lo in range(0, windows, step):
        part = gram[lo : lo + step + SPAN - 1]
        low = (part & ~U((1 << 26) - 1)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(part) - SPAN + 1], low[SPAN - width :])
        out[lo : lo + step] = (low & U((1 << 26) - 1)).astype(np.int64) + lo
    return out


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts: text of each run, first and last string (places in the text), rank at
    ``GRAM`` bytes, rank of the run, and the ranks at ``LENGTH`` bytes by run."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            size += len(texts[last])
            last += 1
        group = texts[first:last]
        lengths = np.array([len(t) for t in group])
        if size >= LENGTH:
            ends = np.cumsum(lengths)
            gram, window = ranks(b"".join(group))
            at = sampled(gram, len(window))
            text = np.repeat(np.arange(len(group)), lengths)[: len(window)]
            inside = np.arange(len(window)) + LENGTH <= ends[text]
            cut = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1]))
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(window)) - 1
            keep = inside[start]
            start, end = start[keep], end[keep]
            whole = _pair(window[start], window[end], 5) + U(0x165667B19E3779F9) * ((at[start] - start) * 64 + end - start).astype(np.uint64)
            base = (ends - lengths)[text[start]]
            yield text[start] + first, start - base, end - base, gram[at[start]], whole, (window, start)
        first = last


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def _send_runs(buckets: int):
    """Packed runs by bucket. Of equal texts in a slice only the least id sends any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                texts = _bytes(part.column("text"))
                rows, copies, seen = [], [], set()
                for i in sorted(range(len(ids)), key=ids.__getitem__):
                    if len(texts[i]) >= LENGTH:
                        (copies if texts[i] in seen else rows).append(i)
                        seen.add(texts[i])
                copies = [i for i in copies if ids[i] > min(ids[j] for j in rows if texts[j] == texts[i])] if copies else []
                sent = [texts[i] for i in rows]
                key = np.array([ids[i] for i in rows], np.int64)
                crc = np.array([zlib.crc32(t) for t in sent], np.uint32)
                found = list(zip(*((t, g, w) for t, _, _, g, w, _ in runs(sent)))) or [[np.zeros(0, k)] for k in (np.int64, np.uint64, np.uint64)]
                text, gram, whole = map(np.concatenate, found)
                bucket = (gram % U(buckets)).astype(np.int64)
                out = []
                for b in range(buckets):
                    mine = np.flatnonzero(bucket == b)
                    here, counts = np.unique(text[mine], return_counts=True)
                    data = (gram[mine] >> U(32)).astype("<u4").tobytes() + (whole[mine] & U(0xFFFFFFFF)).astype("<u4").tobytes() + (whole[mine] >> U(48)).astype("<u2").tobytes()
                    if len(mine):
                        out.append((b, key[here].astype("<i8").tobytes(), crc[here].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), data))
                if copies:
                    who = np.array([ids[i] for i in copies], "<i8").tobytes()
                    out.append((ids[copies[0]] % buckets, who, np.array([zlib.crc32(texts[i]) for i in copies], "<u4").tobytes(), b"", b""))
                if out:
                    values = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32())] + [pa.array(v, pa.binary()) for v in values[1:]], ["bucket", "ids", "crcs", "counts", "data"])

    return run


PACKED = "bucket int, ids binary, crcs binary, counts binary, data binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one bucket after the other."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield now, rows
                rows = []
                give_back()
            now = bucket
            rows.append(row)
    if rows:
        yield now, rows
    give_back()


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and checksums by text, text of each record, place of each record in its text's records."""
    ids = np.frombuffer(b"".join(r[0] for r in rows), "<i8")
    crcs = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
    counts = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(ids)), counts)
    return ids, crcs, text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)


def _emit(bucket: int, ids, crcs, text, place, *flags: np.ndarray) -> pa.RecordBatch | None:
    """One row per text with a flagged record: the places of its records by flag."""
    texts = np.unique(np.concatenate([text[f] for f in flags]))
    if not len(texts):
        return None
    columns = [pa.array(ids[texts]), pa.array(crcs[texts].astype(np.int64)), pa.array(np.full(len(texts), bucket, np.int32))]
    for f in flags:
        owner, places = text[f], place[f].astype("<u4")
        at = np.searchsorted(owner, np.append(texts, np.iinfo(np.int64).max))
        columns.append(pa.array([places[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "crc", "bucket", "covered", "open"][: len(columns)])


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with an equal run in a lesser document, and runs that must be compared by string."""
    for bucket, rows in _by_bucket(batches):
        copies = [r for r in rows if not r[2]]
        for r in copies:
            who, crc = np.frombuffer(r[0], "<i8"), np.frombuffer(r[1], "<u4").astype(np.int64)
            blank = pa.array([b""] * len(who), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(crc), pa.array(np.full(len(who), -1, np.int32)), blank, blank], ["doc_id", "crc", "bucket", "covered", "open"])
        rows = [r for r in rows if r[2]]
        if not rows:
            continue
        ids, crcs, text, place = _unpack(rows)
        sizes = [len(r[3]) // 10 for r in rows]
        gram = np.concatenate([np.frombuffer(r[3], "<u4", n) for r, n in zip(rows, sizes)])
        whole = np.concatenate([np.frombuffer(r[3], "<u4", n, 4 * n).astype(np.uint64) | np.frombuffer(r[3], "<u2", n, 8 * n).astype(np.uint64) << U(32) for r, n in zip(rows, sizes)])
        doc = ids[text]
        order = np.lexsort((doc, whole, gram))
        g, w, d = gram[order], whole[order], doc[order]
        new_gram = np.append(True, g[1:] != g[:-1])
        new_run = new_gram | np.append(True, w[1:] != w[:-1])
        at = np.flatnonzero(new_gram)
        least, most = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        size = np.diff(np.append(at, len(g)))
        live = np.repeat((least != most) & (np.add.reduceat(new_run, at, dtype=np.int64) > 1), size)
        run_at = np.flatnonzero(new_run)
        least_of_run = np.repeat(d[run_at], np.diff(np.append(run_at, len(g))))
        covered, open_ = np.zeros(len(g), bool), np.zeros(len(g), bool)
        covered[order] = d > least_of_run
        open_[order] = live & (d == least_of_run)
        made = _emit(bucket, ids, crcs, text, place, covered, open_)
        if made is not None:
            yield made


def _runs_of(text: bytes, buckets: int):
    """Runs of one text with the bucket of each and its place among that bucket's."""
    for _, start, end, gram, _, (window, at) in runs([text]):
        bucket = (gram % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets))
        return start, end, lambda b, places: order[first[b] + np.frombuffer(places, "<u4").astype(np.int64)], window
    return None


def _send_windows(buckets: int):
    """Packed ranks at ``LENGTH`` bytes of the strings in open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, crcs, texts, all_ = (part.column(c).to_pylist() for c in ("doc_id", "crc", "text", "found"))
                who, where, rank = [], [], []
                for i, found in enumerate(all_):
                    marked = [(f["bucket"], f["open"]) for f in found or () if f["open"]]
                    if not marked:
                        continue
                    start, end, select, window = _runs_of(texts[i].encode(), buckets)
                    chosen = np.sort(np.concatenate([select(b, p) for b, p in marked]))
                    n = end[chosen] - start[chosen] + 1
                    places = np.repeat(start[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    who.append(np.full(len(places), i))
                    where.append(places)
                    rank.append(window[places])
                if not who:
                    continue
                who, where, rank = map(np.concatenate, (who, where, rank))
                bucket = (rank % U(buckets)).astype(np.int64)
                key, crc = np.array([x or 0 for x in ids], np.int64), np.array(crcs, np.uint32)
                out = []
                for b in np.unique(bucket).tolist():
                    mine = np.flatnonzero(bucket == b)
                    here, counts = np.unique(who[mine], return_counts=True)
                    data = rank[mine].astype("<u8").tobytes() + where[mine].astype("<u4").tobytes()
                    out.append((b, key[here].astype("<i8").tobytes(), crc[here].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), data))
                values = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32())] + [pa.array(v, pa.binary()) for v in values[1:]], ["bucket", "ids", "crcs", "counts", "data"])

    return run


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of strings that a lesser document has as well."""
    for bucket, rows in _by_bucket(batches):
        ids, crcs, text, _ = _unpack(rows)
        sizes = [len(r[3]) // 12 for r in rows]
        rank = np.concatenate([np.frombuffer(r[3], "<u8", n) for r, n in zip(rows, sizes)])
        where = np.concatenate([np.frombuffer(r[3], "<u4", n, 8 * n) for r, n in zip(rows, sizes)])
        doc = ids[text]
        order = np.lexsort((doc, rank))
        new = np.append(True, rank[order][1:] != rank[order][:-1])
        at = np.flatnonzero(new)
        least = np.repeat(doc[order][at], np.diff(np.append(at, len(order))))
        covered = np.zeros(len(order), bool)
        covered[order] = doc[order] > least
        made = _emit(bucket, ids, crcs, text, where, covered)
        if made is not None:
            yield made


def _remove(buckets: int):
    """What is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                columns = (part.column(c).to_pylist() for c in ("text", "found", "strings"))
                for text, found, strings in zip(*columns):
                    data = b"" if text is None else text.encode()
                    change = np.zeros(len(data) + 1, np.int64)
                    if any(f["bucket"] < 0 for f in found or ()):
                        change[0] += 1
                        change[-1] -= 1
                    marked = [(f["bucket"], f["covered"]) for f in found or () if f["covered"]]
                    if marked:
                        start, end, select, _ = _runs_of(data, buckets)
                        chosen = np.concatenate([select(b, p) for b, p in marked])
                        np.add.at(change, start[chosen], 1)
                        np.add.at(change, end[chosen] + LENGTH, -1)
                    for s in strings or ():
                        at = np.frombuffer(s, "<u4").astype(np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + LENGTH, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                values = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(v, k) for v, k in zip(values, kinds))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs``.

    A byte goes if a 50-byte string that covers it starts in a document with a lesser id as well.
    ``kept`` holds the bytes left; a cut may fall inside a character. Null texts are empty. Rows
    with a null id neither lose bytes nor cost others any. Rows that share an id never compare with
    each other. Ids must be integers; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    sent = rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_send_runs(buckets), PACKED)
    places = "doc_id long, crc long, bucket int, covered binary"

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    compared = dealt(sent).mapInArrow(_compare_runs, f"{places}, open binary")
    found = compared.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("bucket", "covered", "open")).alias("found"))
    texts = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = texts.join(found, ["doc_id", "crc"], "left")
    # No filter on ``found`` here: both uses of the join must stay one exchange of the texts.
    windows = joined.select("doc_id", "crc", "text", "found").mapInArrow(_send_windows(buckets), PACKED)
    equal = dealt(windows).mapInArrow(_compare_windows, places)
    strings = equal.groupBy("doc_id", "crc").agg(F.collect_list("covered").alias("strings"))
    full = joined.join(strings, ["doc_id", "crc"], "left").select("doc_id", "text", "found", "strings")
    return full.mapInArrow(
        _remove(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
