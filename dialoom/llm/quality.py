"""Quality rules by hashed n-gram likelihood ratios (operator 3). Native expressions only.

Word pairs and word endings are hashed into buckets. One pass over all documents counts them for
the raw corpus and, among a bounded sample of documents labelled good, for the trusted target. A
document's verdict is the mean log ratio of the two multinomials over its n-grams against a
threshold; the same rule holds for every document. Base rules on words and repeats come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.common import SPACE_CHARS
from dialoom.session import freeze

BUCKETS = 1 << 17  # rows of the ratio table: its proven bound
SAMPLE_ROWS = 20_000  # rows labelled good for the target model: a bound, chosen by a hash of the id
PRIOR = 50.0
THRESHOLD = -0.15
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    split = F.split(inner, r"[\x20\x09-\x0D]+")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(split)


def _symbols(text: Column) -> Column:
    """Symbol characters of a text; most have none, which a search settles sooner."""
    n = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(text.rlike(f"[{SYMBOLS}]"), n).otherwise(0).cast("long")


def _repeat_places(ordered: Column) -> Column:
    """Places of windows that occur twice or more; ``ordered``: (hash, place), sorted."""
    again = F.filter(
        ordered,
        lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]),
    )
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and the words as ``_words``.

    A null text counts as empty: all counts 0, base failed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("_words"),
        _symbols(text).alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_windows"),
    ).drop("_lines")
    # Only texts in which a window comes back need the places of their windows.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_ordered", F.when(twice, ordered)).drop("_windows")
    out = out.withColumn("_at", F.when(F.col("_ordered").isNotNull(), _repeat_places(F.col("_ordered")))).drop("_ordered")
    step = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of adjacent word pairs and of each word's last three characters."""
    pairs = F.when(
        F.size(words) > 1,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 2),
            lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)).cast("int"),
        ),
    ).otherwise(F.array().cast("array<int>"))
    endings = F.transform(words, lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(3))), F.lit(buckets)).cast("int"))
    return F.concat(pairs, endings)


def ratio_table(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``bucket, ratio``: log of target over raw probability, at most ``buckets`` rows.

    Raw counts cover all documents. The target's share of a bucket starts from its share of the
    corpus with the weight of ``PRIOR`` n-grams, so that rare buckets say next to nothing.
    """
    chosen = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    # At most ``rows`` ids by construction.
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    exploded = marked.select(
        F.col("_id").isNotNull().cast("long").alias("trusted"), words_of(F.col("text")).alias("_words")
    ).select("trusted", F.explode(ngram_buckets(F.col("_words"), buckets)).alias("bucket"))
    counts = freeze(exploded.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")))
    # One row of two sums, joined to the bounded table as a scalar.
    sums = counts.agg(F.sum("raw").cast("double"), F.sum("target").cast("double")).first()
    total, trusted = sums[0] or 0.0, sums[1] or 0.0
    share = trusted / total if trusted else 1.0
    target = F.col("target") if trusted else F.col("raw")
    ratio = (target + PRIOR * share) / ((F.col("raw") + PRIOR) * share)
    return counts.select("bucket", F.log(ratio).alias("ratio"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words`` and the base counts, ``base_failed, llr, kept`` for each row of ``docs``.

    Null texts count as empty and fail the base rules; null ids and repeated rows get a row like
    any other; without good labels every ratio is 0 and the base rules alone decide.
    """
    ratios = ratio_table(docs, labels, buckets)
    # The table as one array by bucket, of proven size, which the plan holds as a scalar.
    filled = docs.sparkSession.range(buckets).join(ratios, F.col("id") == F.col("bucket"), "left")
    entry = F.struct("id", F.coalesce("ratio", F.lit(0.0)).cast("float").alias("r"))
    array = filled.agg(F.sort_array(F.collect_list(entry)).alias("a")).select(F.transform("a", lambda x: x["r"]))
    based = base_rules(docs).withColumn("_grams", F.when(~F.col("base_failed"), ngram_buckets(F.col("_words"), buckets)))
    based = based.withColumn("_ratios", freeze(array).scalar())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get("_ratios", b).cast("double"))
    out = based.withColumn("llr", total / F.size("_grams"))
    return out.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("llr") >= threshold), F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"
    )
