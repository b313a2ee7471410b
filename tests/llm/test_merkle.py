"""The manifest against a plain tree built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dialoom.llm.merkle import backward, fold, forward, levels_of, merkle_manifest, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    """Levels of the plain tree, from the nodes to the one at the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def path(levels, at):
    """(digest left or None, digest right or None) by level."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((level[other] if other < at else None, level[other] if at < other < len(level) else None))
        at //= 2
    return out


def plain(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    trees = {g: tree([leaf(*r) for r in sorted(groups[g], key=key)]) for g in langs}
    upper = tree([trees[g][-1][0] for g in langs])
    root, out = upper[-1][0], []
    for i, g in enumerate(langs):
        for at, r in enumerate(sorted(groups[g], key=key)):
            steps = path(trees[g], at) + path(upper, i)
            n_chars = r[4] + 1 if tampered(r[0]) and r[4] is not None else r[4]
            digest = leaf(*r[:4], n_chars)
            for left, right in steps:
                digest = sha((left or "") + digest + (right or ""))
            proof = sha("".join((a or "") + (b or "") for a, b in steps))
            out.append((r[0], leaf(*r), trees[g][-1][0], root, proof, digest, digest == root))
    return out


def changed(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def manifest(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("grp", "at", "digest", "n", "altered", "place", "n_rows", "_copy", "root", "leaf", "block"):
        df = df.selectExpr("*", f"cast(null as string) AS `{name}`")
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle_manifest(df, flag, **options)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple("" if v is None else str(v) for v in r))


@pytest.mark.parametrize("n, block_levels", [(1, 8), (2, 1), (3, 2), (60, 2), (200, 3), (700, 8)])
def test_manifest(spark, n, block_levels):
    langs = [None, "de", "en", "en", "en", "", "é"]
    rows = [(i * 3, f"text {i}" * (i % 5), langs[i % 7], f"src{i % 3}", i if i % 11 else None) for i in range(n)]
    got = ordered(manifest(spark, rows, block_levels=block_levels).collect())
    assert got == ordered(plain(rows, changed))
    assert n < 60 or {r[6] for r in got} == {True, False}


def test_hard_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, many languages."""
    same = (5, "same", "en", "s", 4)
    rows = [
        (None, None, None, None, None), (None, "x", "en", "s", 1), same, same, same, (5, "other", "en", "s", 5),
        (6, "", "en", "", 0), (7, None, "en", "s", None), (8, "é日本\n" * 50_000, "fr", "s", 250_000), (-9, "y", "en", None, -1),
        *[(100 + i, "z", f"lang{i}", "s", 2**62) for i in range(40)], (14, "max", "en", "s", 2**63 - 1),
    ]
    assert ordered(manifest(spark, rows, block_levels=2).collect()) == ordered(plain(rows, changed))


def test_empty_table(spark):
    made = manifest(spark, [])
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert made.collect() == []


def test_rows_verify_unless_tampered_with(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(50)]
    assert {r["verified"] for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()} == {True}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 255, 256])
def test_sweeps_of_a_block(n):
    digests = [sha(str(i)) for i in range(n)]
    levels, steps = tree(digests), levels_of(n, 8)
    known = forward(digests, steps)
    proofs = backward(known, steps, ".")
    assert known[steps << 32] == levels[-1][0] and len(levels) == steps + 1
    assert [siblings(p) for p in proofs] == ["".join((a or "") + (b or "") for a, b in path(levels, i)) for i in range(n)]
    assert {fold(d, p) for d, p in zip(digests, proofs)} == {sha(levels[-1][0])}
