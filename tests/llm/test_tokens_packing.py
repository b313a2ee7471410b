import collections
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tests.llm.conftest import hard_rows
from tokenizers import Tokenizer

from dialoom.llm import language_model, packing
from dialoom.llm.language_model import score_documents
from dialoom.llm.token_counts import Counter, count_tokens

PATH = P.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids_of(texts):
    return [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    r = random.Random(5)
    letters = [*" \n\t  aabc'sl1é日本　\x1c\x85.,-", "<|endoftext|>"]
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    return [*made, "", " ", "  ", " a", "a ", "a" * 9000, "ab" * 5000 + " x", " " * 7000 + "a", "".join(r.choice("abcdefgh") for _ in range(9000))]


def test_counts_equal_the_tokenizer():
    assert Counter(PATH).count(odd_texts()) == [len(i) for i in ids_of(odd_texts())]


def test_ids_equal_the_tokenizer():
    assert packing.exact_by_bytes(PATH)
    want = [np.array(i, "<u4").tobytes() for i in ids_of(odd_texts())]
    for by_bytes in (False, True):
        assert packing.Encoder(PATH, by_bytes).encode(odd_texts()) == want


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr("dialoom.llm.packing.CACHE", 3)
    monkeypatch.setattr("dialoom.llm.token_counts.CACHE", 3)
    encoder, counter = packing.Encoder(PATH, True), Counter(PATH)
    for text in odd_texts()[:200]:
        (want,) = ids_of([text])
        assert encoder.encode([text]) == [np.array(want, "<u4").tobytes()]
        assert counter.count([text]) == [len(want)]


def test_count_query(table_of):
    rows = hard_rows()
    got = count_tokens(table_of(rows), PATH, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(ids_of([t or ""])[0]), n > 100) for i, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert count_tokens(table_of([]), PATH).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(table_of, capacity):
    rows = hard_rows()
    got = packing.pack_documents(table_of(rows), PATH, capacity).collect()
    tokens = [(i, ids_of([t or ""])[0] + [0]) for i, t in rows]
    want = collections.Counter()
    for i, ids in tokens:
        cuts = [0, *range(len(ids) - (-(-len(ids) // capacity) - 1) * capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids) for _, ids in tokens)
    assert len(sequences) <= -(-total // capacity) * 1.02 + 1
    assert packing.pack_documents(table_of([]), PATH, capacity).count() == 0


def test_plan_is_exact_and_near_the_bound():
    r = np.random.default_rng(3)
    counts = np.bincount(r.integers(5, 600, 40_000), minlength=2049)
    plan = packing.plan(counts, 2048)
    held = np.zeros(2049, int)
    for filling, n in plan:
        assert sum(k * a for k, a in filling) <= 2048
        for k, a in filling:
            held[k] += a * n
    assert (held == counts).all()
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in plan) <= 1.002 * bound + 1
    assert sum(x for _, x in packing.fractional(counts, 2048)) > 0.4 * bound  # the program places most


@pytest.mark.parametrize(
    ("lengths", "fewest"), [([700], 500), ([700, 1300, 1999], 2000), ([1025], 1000), ([30, 2000], 1000), ([1100, 900, 45], 1000)]
)
def test_lengths_that_fill_nothing_exactly(lengths, fewest):
    """The program places most of what no filling holds without room left."""
    counts = np.zeros(2049, int)
    counts[lengths] = 1000
    assert sum(x for _, x in packing.fractional(counts, 2048)) > 0.8 * fewest
    plan = packing.plan(counts, 2048)
    held = sum(n * np.bincount([k for k, a in f for _ in range(a)], minlength=2049) for f, n in plan)
    assert (held == counts).all() and sum(n for _, n in plan) == fewest


def test_knapsack_equals_brute_force():
    """The dearest full filling, or the dearest of all where none is full."""
    r = random.Random(7)
    for _ in range(300):
        capacity = r.randint(5, 14)
        price = np.zeros(capacity + 1)
        for length in r.sample(range(1, capacity + 1), r.randint(1, 4)):
            price[length] = r.random()
        sold, made = [k for k in range(1, capacity + 1) if price[k]], [(0, 0.0)]
        for used, value in made:  # grows while it is read
            made += [(used + k, value + price[k]) for k in sold if used + k <= capacity]
        full = [v for used, v in made if used == capacity]
        got = packing.best_filling(price, capacity)
        assert sum(k * a for k, a in got.items()) <= capacity
        assert sum(price[k] * a for k, a in got.items()) == pytest.approx(max(full or [v for _, v in made]))


def test_backoff_scores(table_of):
    import math

    rows = [r for r in hard_rows() if r[0] != 10] + [(20, "the cat sat on the mat"), (21, "the cat sat on a hat")]
    lists = [[-1, *ids_of([t or ""])[0]] for _, t in rows]
    context, pair, word = collections.Counter(), collections.Counter(), collections.Counter()
    for x in lists:
        context.update(x[:-1])
        pair.update(zip(x, x[1:]))
        word.update(x[1:])
    want = collections.Counter()
    for (i, _), x in zip(rows, lists):
        own, own_context, log = collections.Counter(zip(x, x[1:])), collections.Counter(x[:-1]), 0.0
        for u, w in zip(x, x[1:]):
            c = pair[u, w] - own[u, w]
            log += math.log(c / (context[u] - own_context[u])) if c else math.log(0.4 * word[w] / word.total())
        want[i, len(x) - 1, round(log, 3)] += 1
    got = score_documents(table_of(rows), PATH).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.log_score, 3)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in got)
    assert score_documents(table_of([]), PATH).count() == 0


def test_groups_of_copies_stay_whole(spark, table_of):
    """A group of 4 % of all bytes lies in one shard; one that no shard can hold is spread evenly."""
    from pyspark.sql import functions as F

    from dialoom.llm.resharding import reshard

    rows = [(i, f"text {i} " * (i % 30 + 1)) for i in range(3000)]
    rows += [(10_000 + i, "copied words " * 15) for i in range(150)] + [(20_000 + i, "small group") for i in range(40)]
    rows += [(30_000 + i, "hot " * 50) for i in range(800)]
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(12))
    placed = reshard(table_of(rows, extra=False), old, 12, [1.0] * 16).select("shard", "size", "row.text").toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and len(placed) == len(rows)
    spread = placed.groupby("text")["shard"].nunique()
    assert spread["hot " * 50] > 1 and spread.drop("hot " * 50).max() == 1
    assert sizes.max() <= 1.1 * sizes.mean() and sizes.min() >= 0.9 * sizes.mean()


def test_slices_do_not_follow_batches():
    """Batches are small, as they count several times in a task's memory; a slice takes up many."""
    texts = ["some words " * 3, None, "", "x" * 50] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["doc_id", "text"]) for i, t in enumerate(texts)]
    made = list(language_model._tokenize(PATH, packing.exact_by_bytes(PATH))(iter(batches)))
    assert [m.num_rows for m in made] == [1]
    ids = np.frombuffer(made[0].column("ids")[0].as_py(), "<i8")
    sizes = np.frombuffer(made[0].column("sizes")[0].as_py(), "<i8")
    assert ids.tolist() == [*range(80)] and sizes.tolist() == [len(x) for x in ids_of([t or "" for t in texts])]
    gathered = list(language_model._gathered(iter(batches), 100))
    assert [i for ids, _ in gathered for i in ids] == [*range(80)]
    assert all(sum(len(t) for t in texts) <= 100 for _, texts in gathered) and len(gathered) > 10


def test_scoring_a_slice_takes_memory_for_some_documents_at_a_time(monkeypatch):
    r = np.random.default_rng(3)
    sizes = r.integers(0, 900, 1200)
    sizes[[0, 5, 6, 1199]] = 0
    tokens = r.zipf(1.3, sizes.sum()).clip(0, 5000).astype("<u4")
    seen, count = np.unique(language_model.bigrams(sizes, tokens), return_counts=True)
    total = lambda key: pa.table([pa.array(x) for x in (lambda k, i: (k, np.bincount(i, count)))(*np.unique(key, return_inverse=True))], ["k", "n"])
    totals = language_model.Totals(total(seen >> 32), total(seen & 0xFFFFFFFF))
    want = language_model.score_slice(sizes, tokens, seen, count, totals)
    tracemalloc.start()
    got = language_model.score_slice(sizes, tokens, seen, count, totals)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(tokens)
    monkeypatch.setattr(language_model, "SCORED_TOKENS", 1)
    assert np.allclose(got, want) and np.allclose(language_model.score_slice(sizes, tokens, seen, count, totals), want)
    assert len(language_model.score_slice(sizes[:0], tokens[:0], seen, count, totals)) == 0
    assert language_model.score_slice(sizes[:1], tokens[:0], seen, count, totals).tolist() == [0]
