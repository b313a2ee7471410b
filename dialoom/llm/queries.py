"""One query per operator over its whole table; SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query
def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


# Every pair of texts that share a shingle; fit for small tables only.
ORACLES["op9_ngram_jaccard"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+', 0) AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s
  FROM worded),
classes AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s, len(any_value(s)) AS n FROM sets GROUP BY list_sort(s)),
listed AS (SELECT node, n, unnest(s) AS h FROM classes),
met AS (
  SELECT a.node AS x, b.node AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM listed a JOIN listed b ON a.h = b.h AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node),
links AS (SELECT x, y FROM met WHERE 100 * shared >= 90 * (nx + ny - shared)),
edges AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT node, node AS other FROM classes
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_ids AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component END AS component_id
FROM sets d JOIN classes c ON c.s = list_sort(d.s) JOIN least_ids l ON l.node = c.node"""


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from dialoom.llm.resharding import reshard, rewrite_affected
    from dialoom.session import fresh_path

    docs = table(spark, sf_dir, "documents")
    # Twelve shards by text so far, so copies share one; sixteen of equal size from now on.
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(12))
    placed = reshard(docs, old, 12, [1.0] * 16)
    rewrite_affected(docs, placed, fresh_path(spark, "resharded"))
    return placed.drop("old_shard", "row")


# The tree level by level. The fixed number is the polynomial of CRC-32 in reversed bit order.
ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE marked AS (
  SELECT *, n_chars + CASE WHEN xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1),
                                              lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS changed
  FROM documents),
fields AS (
  SELECT doc_id, lang, n_chars, changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM marked),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
    sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || body) AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
lower_tree AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM lower_tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2, n),
lower_path AS (
  SELECT doc_id, lang, leaf, pos AS place, 0 AS level, pos, n, '' AS proof, tampered AS folded FROM leaves
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.place, p.level + 1, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.digest, '') ELSE s.digest || p.folded END)
  FROM lower_path p LEFT JOIN lower_tree s
    ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.pos = xor(p.pos, 1)
  WHERE p.n > 1),
upper_path AS (
  SELECT p.doc_id, p.leaf, p.place, s.subroot, 0 AS level, s.pos, s.n, p.proof, p.folded
  FROM lower_path p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.place, p.subroot, p.level + 1, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.digest, '') ELSE s.digest || p.folded END)
  FROM upper_path p LEFT JOIN upper_tree s ON s.level = p.level AND s.pos = xor(p.pos, 1)
  WHERE p.n > 1)
SELECT p.doc_id, p.leaf, p.subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root,
  p.folded = r.digest AS verified
FROM upper_path p, (SELECT digest FROM upper_tree WHERE n = 1) r WHERE p.n = 1"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from dialoom.llm.merkle import merkle_manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered)


ORACLES["op12_ranked_search"] = r"""
WITH worded AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
entries AS (
  SELECT doc_id, term, count(*) AS tf FROM worded
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM entries, totals GROUP BY term),
scored AS (
  SELECT q.item_id, e.doc_id,
    sum(q.times * w.w * ((1000000000 * e.tf) // (1000 * e.tf + 12 * (100 - 25 + ((25 * l.n * t.nn) // t.ll)))))::BIGINT AS score
  FROM wanted q JOIN entries e USING (term) JOIN weights w USING (term) JOIN lengths l USING (doc_id), totals t
  GROUP BY q.item_id, e.doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from dialoom.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.drop("places").withColumn("expressions", F.array_join("expressions", ";"))
