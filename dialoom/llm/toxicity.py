"""Toxicity by fuzzy lexicon matching with context windows (operator 1).

A lexicon of whole words and word stems is learned from labelled documents: those that hardly ever
occur in harmless ones. Its trie is intersected with Levenshtein automata: an automaton state is
a set of (trie node, errors so far), states are made when a text first leads to them, and a word
is read one character at a time until no state is left. Each match has a weight for its term and
its number of errors, learned on the same documents. A window around a match tells abuse (more
matches nearby) from quotation (quote marks, reporting words). A logistic curve over the strongest
window and the sum of all windows gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.common import give_back, returning, slices, stored

SAMPLE_ROWS = 20_000  # labelled rows for learning: a bound, chosen by a hash of the id
MIN_SHARE = 0.02  # of the toxic sample in which a term must occur
CHANCE = 2e4  # candidates of which less than one may be a term by chance
FIRST = 4.0  # weight of an exact match before any sample speaks
FADING = (1.0, 0.75, 0.4)  # what a match with errors is worth before any sample speaks
MIN_RATIO = 5.0  # how much likelier a term is in toxic documents
WINDOW = 8  # words on either side of a match
CACHE = 120_000
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…"
QUOTES = re.compile("[\"«»“”„]")
# Words that report what somebody else said.
REPORTING = frozenset(
    "said says quote quoted quoting wrote writes called calling dit écrit cité sagte schrieb zitiert dijo escribió citó".split()
)

Match = tuple[str, int]  # term, errors


def errors_allowed(term: str) -> int:
    """0 up to 3 characters, 1 up to 8, else 2; a stem, whose end is open, has one less."""
    return (len(term) > 3) + (len(term) > 8) - (term[-1] == "*" and len(term) > 4)


class Lexicon:
    """A trie of terms (a stem ends in ``*``) walked by Levenshtein automata."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[str, int]] = {}
        self.stems: dict[int, tuple[str, int]] = {}
        self.slack = [0]
        for term in terms:
            node, spelled = 0, term.removesuffix("*")
            limit = errors_allowed(term)
            self.slack[0] = max(self.slack[0], limit)
            for c in spelled:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], limit)
            (self.words if spelled == term else self.stems)[node] = (term, limit)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[Match | None] = []
        self.starts: list[Match | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, positions: set[tuple[int, int, str]]) -> int:
        """The state for ``positions``, closed under skipped characters of a term."""
        todo, closed = list(positions), set(positions)
        while todo:
            node, errors, wait = todo.pop()
            if not wait and errors < self.slack[node]:
                for child in self.children[node].values():
                    if errors < self.slack[child] and (new := (child, errors + 1, "")) not in closed:
                        closed.add(new)
                        todo.append(new)
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for known, out in ((self.words, self.ends), (self.stems, self.starts)):
                found = [(e, known[n][0]) for n, e, w in key if not w and n in known and e <= known[n][1]]
                out.append((min(found)[1], min(found)[0]) if found else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached = set()
        for node, errors, wait in self.sets[state]:
            if wait:
                if c == wait:
                    reached.add((node, errors, ""))
                continue
            children = self.children[node]
            if c in children:
                reached.add((children[c], errors, ""))
            if errors < self.slack[node]:
                reached.add((node, errors + 1, ""))
                for d, child in children.items():
                    if errors < self.slack[child]:
                        reached.add((child, errors + 1, ""))
                        if d != c and c in self.children[child]:  # two characters swapped
                            reached.add((self.children[child][c], errors + 1, d))
        next_ = self._state(reached) if reached else -1
        self.steps[state][c] = next_
        return next_

    def match(self, word: str) -> Match | None:
        """The best term for a word: fewest errors, then the longer reading of whole words."""
        if len(self.states) > 200_000:  # bounds the memory of a task
            self.states.clear(), self.sets.clear(), self.steps.clear(), self.ends.clear(), self.starts.clear()
            self.start = self._state({(0, 0, "")})
        state, stem = self.start, None
        for c in word:
            next_ = self.steps[state].get(c)
            state = self._step(state, c) if next_ is None else next_
            if state < 0:
                return stem
            found = self.starts[state]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self.ends[state]
        return whole if whole and (stem is None or whole[1] <= stem[1]) else stem


def spelled(token: str) -> str:
    return token.strip(EDGES).lower()


@dataclass
class Model:
    """Lexicon, weights of (term, errors), weights of the curve."""

    terms: list[str] = field(default_factory=list)
    weights: dict[Match, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-4.0,)

    def weight(self, match: Match) -> float:
        return self.weights.get(match, self.weights.get((match[0], 0), FIRST) * FADING[match[1]])


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.lexicon = model, Lexicon(model.terms)
        self.known: dict[str, Match | int] = {}

    def matches(self, text: str) -> tuple[list[str], list[tuple[int, Match]]]:
        """Words of the whole text, and matches by place."""
        tokens = text.split()
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > CACHE:
                self.known.clear()
            for t in {t for t, m in zip(tokens, found) if m is None or t not in self.known}:
                self.known[t] = self.lexicon.match(spelled(t)) or 0
            found = list(map(self.known.__getitem__, tokens))
        return tokens, [(i, m) for i, m in enumerate(found) if m] if any(found) else []

    def features(self, text: str) -> tuple[float, float, float]:
        """The strongest window, the logarithm of the sum of all, and that of the text's length,
        in which a match comes up by chance."""
        tokens, found = self.matches(text)
        best = total = 0.0
        left = right = 0
        for i, match in found:
            while found[left][0] < i - WINDOW:
                left += 1
            while right < len(found) and found[right][0] <= i + WINDOW:
                right += 1
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = sum(bool(QUOTES.search(t)) for t in around) >= 2 or any(spelled(t) in REPORTING for t in around)
            value = self.model.weight(match) * (1 + 0.25 * min(4, right - left - 1)) * (0.4 if quoted else 1)
            best, total = max(best, value), total + max(0.0, value)
        return best, math.log1p(total), math.log1p(len(tokens)) if total else 0.0

    def score(self, text: str) -> float:
        intercept, *slopes = self.model.curve
        at = intercept + sum(w * x for w, x in zip(slopes, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents, the same ones on every run.

    Rows that repeat an id and its text count once per label; of an id with several texts all take
    part, within the bound.
    """
    by_id = [F.xxhash64("doc_id"), "doc_id", "_toxic"]
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    named = named.filter(F.col("doc_id").isNotNull() & F.col("_toxic").isin(0, 1)).distinct().orderBy(*by_id).limit(rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    # At most ``rows`` rows of numbers by construction, both times.
    found = texts.drop("text").join(F.broadcast(named), "doc_id").distinct().orderBy(*by_id, "_key").limit(rows)
    return texts.join(F.broadcast(found), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_toxic", "_key"]).select("text", "_toxic")


def _distinct_words(sample: DataFrame) -> DataFrame:
    """One row per group of near copies: its label and its distinct words.

    Copies are recognised by the least hash of their five-word runs, so that a copied document
    does not turn all its words into terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, words = [], []
                for text in part.column("text").to_pylist():
                    tokens = [spelled(t) for t in (text or "").split()]
                    runs = zip(*(tokens[k:] for k in range(5))) if len(tokens) >= 5 else [tokens]
                    keys.append(min(xxhash.xxh64_intdigest(" ".join(r)) for r in runs) - (1 << 63))
                    words.append(sorted({t for t in tokens if len(t) > 2}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), part.column("_toxic"), pa.array(words, pa.list_(pa.string()))],
                    ["key", "toxic", "words"],
                )

    made = sample.mapInArrow(returning(run), "key long, toxic int, words array<string>")
    return made.groupBy("key").agg(F.min(F.struct("toxic", "words")).alias("d")).select("d.*")


def _prefix_counts(distinct: DataFrame) -> DataFrame:
    """Documents of either label for each whole word (ends in ``$``) and each word beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                counts = (Counter(), Counter())
                part = batch.slice(start, 200)
                for toxic, words in zip(part.column("toxic").to_pylist(), part.column("words").to_pylist()):
                    counts[toxic].update({w[:k] for w in words for k in range(3, len(w) + 1)} | {f"{w}$" for w in words})
                terms = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"]
                )

    counted = distinct.mapInArrow(returning(run), "term string, clean long, toxic long")
    return counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose_terms(found: list[tuple[str, int, float]]) -> list[str]:
    """Terms from (word or beginning, toxic documents, likelihood ratio).

    The one with most evidence comes first and rules out its own beginnings and, if it is a stem,
    everything that begins with it. Of equals a whole word, then the longer one, is taken.
    """
    taken: dict[str, None] = {}
    beginnings: set[str] = set()
    for term, toxic, ratio in sorted(found, key=lambda x: (-round(x[1] * math.log(x[2]), 6), x[0][-1] != "$", -len(x[0]), x[0])):
        plain = term.removesuffix("$")
        covered = any(f"{plain[:k]}*" in taken for k in range(3, len(plain) + 1)) or plain in taken
        if covered or plain in beginnings or (term == plain and len(plain) < 4):
            continue
        taken[plain if term != plain else f"{plain}*"] = None
        beginnings |= {plain[:k] for k in range(3, len(plain) + 1)}
    return sorted(taken)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.01 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows (the caller leaves out those held back).

    At most ``rows`` rows take part (documented bound); they are stored once and read by all steps.
    Without labels of both kinds the lexicon is empty and every score low.
    """
    sample = stored(labelled_sample(docs, labels, rows), 200)
    distinct = _distinct_words(sample)
    sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    ratio = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    # A word that occurs in s documents has all of them toxic by chance with (toxic / all) ^ s.
    by_chance = math.log(CHANCE) / math.log((sizes[0] + sizes[1]) / sizes[1])
    enough = F.col("toxic") >= max(by_chance, MIN_SHARE * sizes[1])
    counted = _prefix_counts(distinct).withColumn("ratio", ratio).filter(enough & (F.col("ratio") >= MIN_RATIO))
    # All of them: each occurs in a share of the sample's toxic documents, so there are at most
    # 1 / MIN_SHARE times the words and beginnings that one of these has on average.
    model = Model(terms=choose_terms([(r["term"], r["toxic"], r["ratio"]) for r in counted.collect()]))

    def match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for toxic, text in zip(part.column("_toxic").to_pylist(), part.column("text").to_pylist()):
                    rows += [(*m, toxic) for m in {m for _, m in scorer.matches(text or "")[1]}]
                columns = list(zip(*rows)) or [(), (), ()]
                kinds = (pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "errors", "toxic"])

    hits = sample.mapInArrow(returning(match_rows), "term string, errors int, toxic int")
    counts: dict[Match, list[int]] = {}
    # At most terms x 3 x 2 rows.
    for r in hits.groupBy("term", "errors", "toxic").agg(F.count("*").alias("n")).collect():
        counts.setdefault((r["term"], r["errors"]), [0, 0])[r["toxic"]] += r["n"]

    # Log likelihood ratios, shrunk to the first guess while matches are few; exact ones first.
    for match, (clean, toxic) in sorted(counts.items(), key=lambda x: (x[0][1], x[0][0])):
        rate = math.log((toxic + 0.5) / (sizes[1] + 1)) - math.log((clean + 0.5) / (sizes[0] + 1))
        trust = (clean + toxic) / (clean + toxic + 2)
        model.weights[match] = max(0.0, trust * rate + (1 - trust) * model.weight(match))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                made = [scorer.features(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v, pa.float64()) for v in zip(*made)), part.column("_toxic")], ["best", "total", "size", "toxic"]
                )

    rows_ = sample.mapInArrow(returning(feature_rows), "best double, total double, size double, toxic int").collect()  # <= rows
    data = np.array([tuple(r) for r in rows_], float)
    model.curve = fit_curve(data[:, :-1], data[:, -1])
    return model


def toxicity_score(text: Column, model: Model) -> Column:
    """Score in 0..1 of a whole text; null and empty texts have that of a text without matches."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            yield pa.array([scorer.score(t.as_py() or "") for t in texts], pa.float64())
        del scorer
        give_back()

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, mod 5, is 0. Null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Only labels that are not held out teach the model; scores see the text alone. Rows with null
    ids or texts are scored as well (null text: as an empty one); other columns are ignored.
    """
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
