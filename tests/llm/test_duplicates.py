import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import hard_rows, prose

from dialoom.llm import jaccard, substrings
from dialoom.llm.common import stored, with_may_match
from dialoom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies():
    """Groups of edited copies around the threshold, shared passages, tiny texts."""
    r, rows = random.Random(9), []
    for g in range(12):
        base = prose(100 + g, r.choice([8, 30, 90, 150])).split()
        for _ in range(r.choice([2, 5, 25])):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = prose(r.random(), 1)
            rows.append((len(rows) * 3 - 20, " ".join(words)))
    passage = prose(7, 60)
    rows += [(1000 + i, prose(500 + i, 30) + " " + passage + " " + prose(900 + i, r.randint(1, 200))) for i in range(120)]
    rows += [(2000 + i, " ".join(r.choice(["of", "the", "and"]) for _ in range(r.randint(1, 9)))) for i in range(80)]
    return rows


def brute_components(rows, k, percent):
    """For each row: size of its set, least id and place of the first row (ids, null ones last)."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rank = lambda x: (rows[x][0] is None, rows[x][0] or 0, x)
    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b]:
                both = len(s & sets[b])
                if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y, key=rank)] = min(x, y, key=rank)
    return [(len(s), rows[find(i)][0], find(i)) for i, s in enumerate(sets)]


def shared_ids():
    """Rows that share an id, or have none, with texts that link and texts that do not."""
    a, b, c = prose(41, 60), prose(42, 50), prose(43, 40)
    return [
        (3001, a), (3002, a), (3002, b), (3003, b), (3003, c), (3003, c), (None, c + " " + c), (None, c + " " + c), (3004, c + " " + c),
        (None, prose(44, 30)), (None, prose(44, 30) + " more"), (None, ""), (None, "two words"), (3005, a + " end"),
    ]


@pytest.mark.parametrize("k,percent,settings", [(3, 90, {}), (5, 80, {}), (3, 90, {"LONG_LIST": 4, "BLOCK_ROWS": 6}), (2, 60, {"LONG_LIST": 2, "MEETINGS": 2})])
def test_jaccard(table_of, monkeypatch, k, percent, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = [r for r in hard_rows() if r[0] != 10] + near_copies() + shared_ids()
    want = collections.Counter((i, n, first) for (i, _), (n, first, _) in zip(rows, brute_components(rows, k, percent)))
    found = jaccard.jaccard_components(table_of(rows), k, percent)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert collections.Counter(map(tuple, found.collect())) == want


def test_jaccard_of_nothing(table_of):
    assert jaccard.jaccard_components(table_of([])).count() == 0
    assert jaccard.jaccard_components(table_of([(1, None), (2, "")])).count() == 2


def test_keep_one(table_of):
    rows = hard_rows()
    docs = table_of(rows)
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 3} & {*ids}
    assert ids.count(None) == 1 and {4, 5, 6, 7, 8, 9, 10, 11, 12, 13, -5} <= {*ids}


def test_keep_one_leaves_a_row_of_each_group(table_of):
    text = prose(61, 80)
    rows = [(1, text), (1, text), (2, text), (None, prose(62, 70)), (None, prose(62, 70)), (4, prose(63, 40)), (4, ""), (4, ""), (4, None)]
    rows += shared_ids() + [r for r in near_copies() if r[0] < 1000]
    want = [r for at, (r, (n, _, first)) in enumerate(zip(rows, brute_components(rows, 5, 80))) if n == 0 or first == at]
    got = jaccard.keep_one(table_of(rows)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)


def test_keep_one_chooses_among_repeated_rows_by_their_columns(spark):
    rows = [(1, prose(64, 30), i % 3) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int")
    first, second = (jaccard.keep_one(d).collect() for d in (docs, docs.repartition(4)))
    assert first == second and len(first) == 1 and jaccard.keep_one(docs).dtypes == docs.dtypes


def lists_of(rows, batch):
    """Pairs that meet, from rows ``h, n, node`` in batches of ``batch`` rows."""
    rows = sorted(rows)
    cut = [rows[i : i + batch] for i in range(0, len(rows), batch)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*b)], ["h", "n", "node"]) for b in cut]
    made = [r for b in jaccard._read_lists(90)(iter(batches)) for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "need")))]
    return sorted(made)


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_lists_are_read_whole_in_any_batches(monkeypatch, batch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard, "READ_ROWS", 5)
    r, rows = random.Random(5), set()
    for h in range(30):
        rows |= {(h, 100 + node % 13, node) for node in r.sample(range(200), r.choice([1, 2, 4, 5, 9, 40]))}
    rows |= {(node, -1, 500) for node in range(3)}
    want = [(node, 500, 0) for node in range(3)]
    for h in range(30):
        own = sorted(x[1:] for x in rows if x[0] == h and x[1] > 0)
        if len(own) > 4:
            want += [(min(own[0][1], b), max(own[0][1], b), 0) for _, b in own[1:]]
        else:
            fits = [(x, y) for i, x in enumerate(own) for y in own[i + 1 :] if 90 * y[0] <= 100 * x[0]]
            want += [(min(a, b), max(a, b), min(4, -(-90 * m // 100))) for (n, a), (m, b) in fits]
    assert lists_of(rows, batch) == sorted(want)


def test_long_lists_leave_their_task_as_ties(monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    sets = pa.RecordBatch.from_arrays(
        [pa.array(range(50)), pa.array([9] * 50), pa.array([[7, 1000 + i] for i in range(50)], pa.list_(pa.int64()))], ["node", "n", "prefix"]
    )
    rows = [r for b in jaccard._send_postings([sets]) for r in zip(*(b.column(c).to_pylist() for c in ("h", "n", "node")))]
    assert sorted(x for x in rows if x[0] >= 1000) == [(1000 + i, 9, i) for i in range(50)]
    assert [x for x in rows if x[0] == 7 and x[1] > 0] == [(7, 9, i) for i in range(5)]
    assert sorted(x for x in rows if x[1] < 0) == [(i, -1, 0) for i in range(5, 50)]


def test_texts_travel_only_if_a_join_may_need_them(table_of):
    """Only candidates' texts are joined: an exchange of all texts does not fit the disk limit."""
    docs = table_of([(i, prose(7000 + i, 40)) for i in range(60)] + [(100, prose(7000, 40) + " end")], extra=False)
    sent = docs.select(jaccard._row_key().alias("row"), "doc_id", "text")
    few = sent.filter("doc_id IN (0, 100)").select("row")
    marked = with_may_match(sent, F.col("row"), F.col("row"), few, "may")
    assert marked.columns == ["row", "doc_id", "text", "may"]
    got = {r.doc_id: r.may for r in marked.collect()}
    assert len(got) == 61 and got[0] and got[100] and sum(got.values()) < 15
    assert not any(r.may for r in with_may_match(sent, F.col("row"), F.col("row"), few.filter("false"), "may").collect())
    plan = jaccard.keep_one(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_key_bits") >= 2


def test_rare_shingles_come_first_whatever_the_size(table_of, monkeypatch):
    """A shingle that is common in all rows counts as common, though few of the least sample have it."""
    rows = [(i, prose(9000 + i, 12) + " " + prose(1 + i % 20, 9)) for i in range(400)]
    monkeypatch.setattr(jaccard, "SAMPLE_SHARE", 1)
    levels = jaccard._levels(table_of(rows), 3, 2)
    one = jaccard.Shingler(3)
    common = np.concatenate([one.shingles(prose(1 + i, 9)) for i in range(20)])
    at = lambda s: levels[s >> np.uint64(65 - len(levels).bit_length())]
    assert (at(common) >= 4).all()
    s = one.shingles(rows[0][1])
    first = jaccard.rare_first(s, levels, len(s))
    assert sorted(first) == sorted(s) and (np.diff(at(first).astype(int)) >= 0).all()


def test_a_group_that_fits_a_block_is_sent_once(spark, table_of, monkeypatch):
    seen = []
    base = prose(8000, 300).split()
    rows = [(i, " ".join(base[: 300 - 4 * i])) for i in range(12)]
    monkeypatch.setattr(jaccard, "stored", lambda df, *a: seen.append(stored(df, *a)) or seen[-1])
    assert {r.component_id for r in jaccard.jaccard_components(table_of(rows)).collect()} == {0}
    sent = [df for df in seen if "blocks" in df.columns]
    assert len(sent) == 1 and [len(r.blocks) for r in sent[0].collect()] == [1] * 12


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_in_block():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(5, 50))).astype(np.uint64) for _ in range(80)]
    sets = sorted(sets + sets[:5], key=len)
    a, b = jaccard.links_in_block(sets, 60)
    root = list(range(len(sets)))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        root[find(root, x)] = find(root, y)
    brute = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            if 100 * both >= 60 * (len(s) + len(sets[j]) - both):
                brute[find(brute, i)] = find(brute, j)
    same = lambda root: {frozenset(i for i in range(len(sets)) if find(root, i) == c) for c in {find(root, i) for i in range(len(sets))}}
    assert same(root) == same(brute)


def brute_removed(rows):
    first, out = {}, collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, x in data:
        if i is not None:
            for j in range(len(x) - 49):
                s = x[j : j + 50]
                first[s] = min(first.get(s, i), i)
    for i, x in data:
        gone = bytearray(len(x))
        if i is not None:
            for j in range(len(x) - 49):
                if first[x[j : j + 50]] < i:
                    gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out[i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def shared_strings():
    r, rows = random.Random(4), []
    parts = [prose(300 + i, 14) for i in range(12)]
    for i in range(150):
        text = " ".join(r.choice(parts)[r.randint(0, 20) : r.randint(45, 120)] if r.random() < 0.5 else prose(r.random(), 9) for _ in range(6))
        rows.append((r.randint(-30, 200), text))
    rows += [(300 + i, "ab" * (20 + i)) for i in range(12)] + [(320 + i, "z" * (46 + i)) for i in range(8)]
    rows += [(340, parts[0][:49]), (341, parts[0][:50]), (342, "é" * 24), (343, "é" * 25), (344, "é" * 26)]
    return rows


@pytest.mark.parametrize("chunk", [1 << 19, 400])
def test_substrings(table_of, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rows = [r for r in hard_rows() if r[0] != 10] + shared_strings()
    got = substrings.remove_repeats(table_of(rows)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_substrings_of_nothing(table_of):
    assert substrings.remove_repeats(table_of([])).count() == 0
