import collections
import hashlib
import random
import re
import zlib

import pytest
from tests.llm.conftest import hard_rows, prose

from dialoom.llm import decontamination, pii, quality, resharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Plain forms of the base patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_pii(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def pii_rows():
    r = random.Random(8)
    alphabet = [*"ab1.@+-% _(é", "4111111111111111", "a@b.c", "1.2.3.4", "+1 555", "..", "  ", "255.", "日"]
    made = [(100 + i, "".join(r.choice(alphabet) for _ in range(r.randint(1, 40)))) for i in range(3000)]
    return made + [(1, "1" * 50_000), (2, "1 " * 30_000), (3, "a@" + "b." * 30_000 + "c"), (4, "a" * 60_000 + "@"), (5, "1." * 30_000), (6, "+" + "1 " * 20_000)]


def test_pii(table_of):
    rows = hard_rows() + pii_rows()
    got = pii.find_pii(table_of(rows)).collect()
    want = collections.Counter()
    for i, t in rows:
        # The plain form would take quadratic time on the very long runs; their answers are known.
        long_run = len(t or "") >= 30_000 and i in range(1, 7)
        spans = [f"email:0:{len(t)}"] if i == 3 and long_run else None if long_run else brute_pii(t or "")
        if spans is not None:
            counts = tuple(sum(s.startswith(k) for s in spans) for k in PLAIN)
            want[i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    have = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    assert not want - have
    assert len(got) == len(rows)
    assert pii.find_pii(table_of([])).count() == 0


def test_pii_adds_kinds(table_of):
    rows = [(1, "pay to GB82WEST12345698765432 now"), (2, "pay to GB83WEST12345698765432"), (3, "SSN 123-45-6789"), (4, "order 123-45-6789"), (5, "123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.find_pii(table_of(rows)).collect()}
    assert got == {1: "iban:7:29", 2: "", 3: "national:4:15", 4: "", 5: ""}


def test_redact(table_of):
    rows = hard_rows() + [(50, "é a@b.co, +1 (555) 123-4567!"), (51, "+4111 1111 1111 1111"), (52, "none")]
    docs = table_of(rows).selectExpr("*", "cast(length(text) as long) AS n_chars")
    out = pii.redact(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.filter("doc_id >= 13").collect()}
    assert got[13] == (t := "card [CARD] mail [EMAIL] ip [IP] call [PHONE]", len(t))
    assert got[50][0] == "é [EMAIL], [PHONE]!"
    assert got[52] == ("none", 4)
    assert "1111" not in got[51][0]
    assert out.count() == len(rows)


def brute_base(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(covered), failed


def test_quality(table_of, labels_of):
    r = random.Random(6)
    rows = hard_rows() + [(200 + i, "\n".join(prose(r.randint(0, 30), r.randint(0, 12)) + r.choice(["", " ", "$$", "\x0b", "　"]) for _ in range(12))) for i in range(150)]
    good = [(200 + i, 1, 0) for i in range(0, 150, 2)]
    got = quality.quality_verdicts(table_of(rows), labels_of([*good, (None, 1, 0), (4, None, None)]), buckets=4096).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = collections.Counter((i, *brute_base(t or "")) for i, t in rows)
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_verdicts(table_of([]), labels_of([]), buckets=64).count() == 0
    alone = quality.quality_verdicts(table_of(rows), labels_of([]), buckets=64).collect()
    assert all(r.kept != r.base_failed for r in alone)


def test_quality_tells_junk(table_of, labels_of):
    junk = [(i, " ".join(w + "$$$" for w in prose(i, 60).split())) for i in range(60)]
    r = random.Random(1)
    common = "of the and tree house river is in on to by at".split()
    good = [(100 + i, " ".join(r.choice(common) for _ in range(80))) for i in range(60)]
    got = quality.quality_verdicts(table_of(junk + good), labels_of([(100 + i, 1, 0) for i in range(30)]), buckets=1 << 12).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert not {i for i, _ in junk} & kept
    assert len({i for i, _ in good} & kept) >= 55


def toxic_corpus():
    r, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["blockhead", "numbskull", "grubstem" + prose(r.random(), 1)])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(table_of, labels_of):
    rows, labels = toxic_corpus()
    probes = [(1000, prose(1000, 30) + " blokhead " + prose(1001, 30) + " numbskul " + prose(1002, 9)), (1001, prose(1003, 60)), (1002, "grubstemxyz and blockhead")]
    got = {r.doc_id: r for r in toxicity.score_documents(table_of(rows + probes), labels_of(labels)).collect()}
    tested = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in tested) for i, _ in rows)
    assert sum(got[i].predicted == (i % 4 == 0) for i in tested) >= 0.95 * len(tested)
    assert (got[1000].predicted, got[1001].predicted, got[1002].predicted) == (1, 0, 1)
    # Held-out labels teach nothing: flipping them changes no score.
    flipped = [(i, q, 1 - t if i in tested else t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in toxicity.score_documents(table_of(rows + probes), labels_of(flipped)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_sample_of_repeated_rows(table_of, labels_of):
    """Repeated rows and labels teach once; of many texts of one id no more than the bound are read."""
    rows, labels = toxic_corpus()
    learnt = toxicity.learn(table_of(rows), labels_of(labels))
    again = toxicity.learn(table_of(rows + rows[:40] * 3), labels_of(labels + labels[::2]))
    assert (again.terms, again.weights) == (learnt.terms, learnt.weights) and learnt.terms
    many = [(1, f"text {i}") for i in range(500)] + [(2, "x"), (None, "y"), (3, None)]
    got = toxicity.labelled_sample(table_of(many), labels_of([(1, 1, 1), (2, 1, 0), (3, 1, 0)]), 100).collect()
    assert len(got) == 100 and len(toxicity.labelled_sample(table_of(many), labels_of([(2, 1, 0), (3, 1, 0)]), 100).collect()) == 2


def test_toxicity_of_hard_rows(table_of, labels_of):
    rows = hard_rows()
    for labels in ([], [(1, 1, 1)], [(None, 1, 1), (1, 1, 0), (2, 1, 1), (4, None, 1), (5, 0, 0)]):
        got = toxicity.score_documents(table_of(rows), labels_of(labels)).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_documents(table_of([]), labels_of([])).count() == 0


def edits(a, b, swaps=True):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lexicon_matches_brute_force():
    terms = ["scum", "loser", "worthless", "vequ*", "grubstem*", "abc"]
    lexicon, r = toxicity.Lexicon(terms), random.Random(1)
    for _ in range(4000):
        word = list(r.choice(terms).removesuffix("*") + r.choice(["", "", "x", "yz"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = r.choice(["", "a", "s", "e"])
        word = "".join(word)
        best = min(
            (
                e
                for t in terms
                for e in ([edits(t, word)] if t[-1] != "*" else [edits(t[:-1], word[:k]) for k in range(len(word) + 1)])
                if e <= toxicity.errors_allowed(t)
            ),
            default=None,
        )
        found = lexicon.match(word)
        assert (found and found[1]) == best, word


def test_quotation_weighs_less():
    scorer = toxicity.Scorer(toxicity.Model(["scum"], {("scum", 0): 5.0}, (-3.0, 1.0, 0.0, 0.0)))
    assert scorer.score("you are scum") > scorer.score('he said "you are scum" to me')


@pytest.mark.parametrize("seed", range(3))
def test_myers(seed):
    r = random.Random(seed)
    for _ in range(150):
        p = "".join(r.choice("ab") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        assert decontamination.myers(decontamination.masks_of(p), len(p), t)[0] == min(row)


def test_leaks(spark, table_of):
    r = random.Random(2)
    items = [(i, prose(50 + i, r.randint(8, 40))) for i in range(30)] + [(98, None), (99, " "), (100, "short")]
    rows = hard_rows()
    for i, text in items[:30]:
        for n in (0, 0.03, 0.07, 0.2):
            t = list(text.upper() if i % 2 else text)
            for _ in range(int(n * len(t))):
                t[r.randrange(len(t))] = r.choice("xyz ")
            rows.append((1000 + len(rows), prose(len(rows), 20) + "\n " + "".join(t) + " " + prose(len(rows) + 1, 20)))
    want = set()
    for i, text in rows:
        for k, item in items:
            item = decontamination.normalize(item or "")
            if item and text and len(text) < 20_000:
                d = decontamination.myers(decontamination.masks_of(item), len(item), decontamination.normalize(text))[0]
                if d <= decontamination.budget(item):
                    want.add((i, k, d))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table_of(rows)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert all(d <= decontamination.budget(decontamination.normalize(dict(items)[k])) for _, k, d in got)
    kept = decontamination.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - len([1 for i, _ in rows if i in {w[0] for w in want}])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, empty).count() == 0
    assert decontamination.without_leaks(docs, empty).count() == len(rows)
    assert decontamination.find_leaks(table_of([]), benchmark).count() == 0


def test_leaks_in_blocks(spark, table_of, monkeypatch):
    items = [(i, prose(50 + i, 20)) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table_of([(i, f"so {t} it") for i, t in items])
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, benchmark).collect()} == {(i, i) for i, _ in items}
    assert decontamination.without_leaks(docs, benchmark).count() == 0


def test_least_transfers():
    flow = resharding.least_transfers([60, 30, 10], [25, 25, 25, 25])
    assert [sum(r) for r in flow] == [60, 30, 10] and [sum(c) for c in zip(*flow)] == [25] * 4
    assert [flow[i][i] for i in range(3)] == [25, 25, 10]
    assert resharding.least_transfers([0, 0], [0, 0, 0]) == [[0] * 3] * 2


def test_reshard(spark, table_of, tmp_path):
    from pyspark.sql import functions as F

    rows = hard_rows() + [(300 + i, prose(i % 150, 5 + i % 90)) for i in range(900)]
    docs = table_of(rows)
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(5))
    got = resharding.reshard(docs, old, 5, [1.0] * 8).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Equal but for the largest row.
    largest = max(r.size for r in got)
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + largest
    assert resharding.reshard(table_of([]), old, 5, [1.0] * 8).count() == 0


def test_rewrite_only_what_changes(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, "x" * 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 30, 1).otherwise(2)
    placed = resharding.reshard(docs, old, 3, [1.0, 1.0, 1.0, 1.0])
    path = str(tmp_path / "shards")
    assert resharding.rewrite_affected(docs, placed, path) == [0, 3]
    back = spark.read.parquet(path)
    assert back.groupBy("shard").count().orderBy("shard").collect() == [(0, 10), (3, 10)]


def test_rewrite_keeps_every_row(spark, table_of, tmp_path):
    """Null ids, repeated ids and rows, and columns named like those of the placement."""
    from pyspark.sql import functions as F

    rows = [r for r in hard_rows() if r[0] != 10] + [(None, "no id"), (20, "one"), (20, "two"), (20, "two")] + [(300 + i, prose(i, 20)) for i in range(60)]
    docs = table_of(rows).withColumn("shard", F.concat(F.lit("mine "), F.coalesce("text", F.lit("-"))))
    old = F.lit(0)
    placed = resharding.reshard(docs, old, 1, [1.0] * 4)
    path = str(tmp_path / "shards")
    affected = resharding.rewrite_affected(docs, placed, path)
    back = spark.read.parquet(path)
    assert {*back.columns} == {*docs.columns, "_shard", "_slot"}
    count = lambda df: collections.Counter(map(tuple, df.select(*docs.columns).collect()))
    assert count(back) == count(docs)
    places = lambda df, shard, slot: sorted(map(tuple, df.select(shard, slot).collect()))
    assert places(back, "_shard", "_slot") == places(placed, "shard", "slot") and affected[0] == 0


def test_reshard_query_rewrites_shards(spark, monkeypatch, tmp_path):
    import dialoom.session
    from dialoom.llm import queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(dialoom.session, "fresh_path", lambda spark, name: str(tmp_path / name))
    placed = queries.op7_reshard(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old = "pmod(xxhash64(coalesce(text, '')), 12)"
    moved = placed.join(docs.selectExpr("doc_id", f"{old} AS was"), "doc_id").filter("shard != was").collect()
    affected = {r.shard for r in moved} | {r.was for r in moved}
    assert affected
    placed = placed.filter(placed.shard.isin(affected)).checkpoint()
    docs = docs.join(placed.select("doc_id"), "doc_id", "left_semi")
    back = spark.read.parquet(str(tmp_path / "resharded"))
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(back, "doc_id", "shard", "slot") == key(placed, "doc_id", "shard", "slot")
    assert key(back, "doc_id", "text") == key(docs, "doc_id", "text")
