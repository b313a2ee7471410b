"""Personal data by patterns, checksums and context (operator 5). Native expressions only.

Patterns propose spans; validators confirm them (Luhn for cards, mod 97 for IBANs, digit counts,
ranges of address parts); words nearby raise or lower the score of kinds that digits alone do not
settle. A pattern's places come from the text between its matches: the lengths of both, summed.

The patterns accept what the plain forms below accept, leftmost and without overlaps, but cannot
backtrack over long runs: possessive runs, no start inside a run, and lazy steps over single
characters in place of repeated groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.masks import running_sums
from dialoom.functions.turns import let

# kind -> pattern. Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# [0-9]+(\.[0-9]+){3}, [0-9]([ -]?[0-9])+, \+[0-9][ ().0-9-]+[0-9]
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?=[ -]{2}|[ -]?(?![0-9 -]))"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT_CHARS = 40
# Words that make a nine-digit number an identity number, or another kind of number.
IDENTITY = r"(?i)\b(?:ssn|social security|tax id|passport|national id)\b"
OTHER = r"(?i)\b(?:order|invoice|part|serial|version|isbn)\b"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national")
KEPT_SCORE = 0.5


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<m, s, e>>``: matches with places in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(
        found,
        F.slice(between, 1, F.size(found)),
        lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")),
    )

    def placed(pairs: Column, lengths: Column) -> Column:
        # A match ends where all gaps and matches up to it do: sums that cost about their number.
        return F.zip_with(
            pairs,
            F.slice(running_sums(0, lengths), F.lit(2), F.size(pairs)),
            lambda p, e: F.struct(p["m"].alias("m"), (e - p["n"]).cast("int").alias("s"), e.cast("int").alias("e")),
        )

    spans = let(pairs, lambda p: let(F.transform(p, lambda x: x["gap"] + x["n"]), lambda n: placed(p, n)))
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the weighted digit sum is divisible by ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    places = F.transform(F.sequence(F.lit(0), n - 1), value)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 when its first four characters go last."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    letters = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, 1))
    return F.aggregate(letters, F.lit(0), step) == 1


def _window(text: Column, span: Column) -> Column:
    start = F.greatest(span["s"] - CONTEXT_CHARS, F.lit(0))
    return F.substr(text, start + 1, span["e"] - start + CONTEXT_CHARS)


def score(kind: str, text: Column, span: Column) -> Column:
    """0..1. Base kinds are settled by their validators; the others need proof or context."""
    match = span["m"]
    if kind == "email":
        return F.lit(0.9)
    if kind == "ip":
        fits = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
        return F.when(fits, 0.8).otherwise(0.0)
    if kind == "card":
        digits = digits_of(match)
        return F.when(F.length(digits).between(16, 19), F.when(luhn(digits), 0.9).otherwise(0.0)).otherwise(0.0)
    if kind == "phone":
        return F.when(F.length(digits_of(match)).between(8, 15), 0.7).otherwise(0.0)
    if kind == "iban":
        return F.when(mod97(match), 0.9).otherwise(0.1)
    near = _window(text, span)
    return 0.3 + F.when(near.rlike(IDENTITY), 0.4).otherwise(0.0) - F.when(near.rlike(OTHER), 0.3).otherwise(0.0)


PATTERNS = {"email": EMAIL, "ip": IP, "card": DIGITS, "phone": PHONE, "iban": IBAN, "national": NATIONAL}


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "_pii_") -> DataFrame:
    """``docs`` with one column ``<prefix><kind>`` of confirmed spans per kind.

    A null text has none. A cheap look for the characters a kind needs spares most texts the
    patterns.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]")
    needs = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    found = docs.select(
        "*", *(F.when(needs.get(k, digit), matches(t, p)).otherwise(empty).alias(f"{prefix}{k}") for k, p in PATTERNS.items())
    )
    return found.withColumns(
        {f"{prefix}{k}": F.filter(f"{prefix}{k}", _confirmed(k, t)) for k in KINDS}
    )


def _confirmed(kind: str, text: Column):
    return lambda span: score(kind, text, span) >= KEPT_SCORE


def _written(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string"))


def _tagged(kind: str):
    return lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(kind).alias("k"))


def _listed(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.concat(*(F.transform(f"_pii_{k}", _written(k)) for k in kinds)), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` and all ``spans`` per row of ``docs``.

    A null or empty text has no span: counts 0, the digest of an empty list, empty ``spans``.
    """
    found = with_spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(BASE).cast("binary"), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; same columns.

    Spans that overlap become one, named after the first. Texts without spans, and null texts, stay
    as they are. An ``n_chars`` column follows the text.
    """
    prefix = "_pii_" + "_" * max(map(len, docs.columns), default=0)  # clashes with no column
    found = with_spans(docs, prefix=prefix)
    tagged = F.concat(*(F.transform(f"{prefix}{k}", _tagged(k)) for k in KINDS))
    found = found.withColumn(f"{prefix}all", F.sort_array(tagged)).drop(*(f"{prefix}{k}" for k in KINDS))
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substr(t, state["at"] + 1, s["s"] - state["at"])
        label = F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))
        apart = F.struct(s["e"].alias("at"), F.concat(state["out"], gap, label).alias("out"))
        return F.when(s["s"] >= state["at"], apart).otherwise(
            F.struct(F.greatest(state["at"], s["e"]).alias("at"), state["out"].alias("out"))
        )

    done = F.aggregate(f"{prefix}all", start, add, lambda x: F.concat(x["out"], F.substr(t, x["at"] + 1)))
    text = F.when(F.size(f"{prefix}all") > 0, done).otherwise(t)
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.size(f"{prefix}all") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
