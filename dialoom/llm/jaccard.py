"""Exact Jaccard join of shingle sets by set relations (operator 9).

1. Rows with equal sets are one class, whatever their ids; one row stands for all.
2. Each set lists a prefix of its shingles, rare ones first. Two sets with enough in common share
   several prefix shingles, so candidates are pairs that meet often enough in short index lists, or
   at all in a long one (where every set is tied to the list's first instead of to each other).
   Index lists are read where their one shuffle has sorted them.
3. Candidates fall into groups. Only there whole sets are compared, in blocks by size: index lists
   are read whole and sizes mask the result, and a set that agrees with an earlier one in all
   that the block indexes takes over its answer. A block reports a forest of its links, which is
   linear in its sets. Texts travel, not sets, which are longer, and only those of candidates.
4. Components of the links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.common import returning, slices, stored, with_may_match
from dialoom.llm.components import components, forest

# Rows whose shared shingles are put last in the order: so many at least, and a share of all. Only
# speed depends on this, and on the number of such shingles, most frequent first.
SAMPLE_ROWS, SAMPLE_SHARE = 30_000, 8
COMMON_ROWS = 1_500_000
LONG_LIST = 64
LISTED_SETS, READ_ROWS = 4000, 60_000  # sets whose prefixes, and rows of index lists that, are handled at once
# Shared prefix shingles of a candidate pair: so many at least, and a share of the smaller set.
MEETINGS, MEETING_PERCENT = 4, 2
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 1_000_000
CACHE = 120_000
NO_SHINGLES = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles."""

    def __init__(self, k: int) -> None:
        self.k, self.known = k, {}

    def shingles(self, text: str | None) -> np.ndarray:
        # Bytes fold and split just the ASCII letters and white space.
        words = text.encode().lower().split() if text else []
        if not words:
            return NO_SHINGLES
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        codes = list(map(self.known.get, words))
        if None in codes:
            if len(self.known) > CACHE:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            codes = list(map(self.known.__getitem__, words))
        hashes = np.array(codes, np.uint64)
        n = len(words) - self.k + 1
        made = np.zeros(n, np.uint64)
        for i in range(self.k):
            made = _mix(made + hashes[i : i + n] + np.uint64(i + 1))
        made.sort()
        return made[np.append(True, made[1:] != made[:-1])]


def meetings(n):
    return np.maximum(MEETINGS, MEETING_PERCENT * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + int(meetings(n)))


def _row_key() -> Column:
    """A hash of a row's id and text: what finds its text again."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _levels(docs: DataFrame, k: int, rows: int) -> np.ndarray:
    """How common shingles are, on a scale of powers of two, by the first bits of their hash.

    Counted are those of ``rows`` rows at least, chosen by a hash of id and text, and of a share of
    all. What no two of these have is at 0.
    """
    total = docs.count()
    share = min(1.0, max(rows, total // SAMPLE_SHARE) / max(1, total))
    sample = docs.select("text") if share == 1 else docs.filter(_row_key().bitwiseAND(0xFFFFF) < int(share * 2**20) + 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for part in slices(batch):
                sets = {s.tobytes(): s for s in map(shingler.shingles, part.column("text").to_pylist())}
                hashes, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["h", "n"])

    counted = sample.mapInArrow(returning(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = stored(counted.filter("n > 1"))
    by_count = shared.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect()
    chosen, least = 0, 1001
    for n, count in by_count:  # at most a row for each count up to 1000
        if chosen + count > COMMON_ROWS and chosen:
            break
        chosen, least = chosen + count, n
    bits = max(10, min(23, (4 * min(chosen, COMMON_ROWS)).bit_length()))
    levels = np.zeros(1 << bits, np.uint8)
    cell = F.shiftrightunsigned("h", 64 - bits).cast("int")
    top = shared.filter(F.col("n") >= least).groupBy(cell.alias("cell")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level"))
    found = top.toArrow()  # at most a row for each of 2 ** 23 cells
    if found.num_rows:
        levels[found.column("cell").to_numpy()] = found.column("level").to_numpy()
    return levels


def rare_first(s: np.ndarray, levels: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of a set in the order of all shingles: by level, then by hash."""
    level = levels[s >> np.uint64(65 - len(levels).bit_length())]
    return s[np.argsort(level, kind="stable")[:most]] if level.any() else s[:most]


def set_table(docs: DataFrame, k: int, percent: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, row, n, digest, prefix`` of each row of ``docs``; ``row`` is its ``_row_key``."""
    levels = _levels(docs, k, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for part in slices(batch):
                sizes, digests, prefixes = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingler.shingles(text)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    prefixes.append(rare_first(s, levels, prefix_length(len(s), percent)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "n", "digest", "prefix"],
                )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), "text")
    return rows_.mapInArrow(returning(run), "doc_id long, row long, n long, digest binary, prefix array<long>")


def _send_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, n, node``. Of a list that is long here already only so many go as make it long, the
    rest are ties, which are dealt out by their node: ``h`` is a node, ``n`` is -1."""
    for batch in batches:
        counts = pa.compute.list_value_length(batch.column("prefix")).to_numpy()
        node, n = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("node", "n"))
        h = batch.column("prefix").flatten().to_numpy()
        order = np.argsort(h, kind="stable")
        begins = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, int)
        long = np.diff(np.append(begins, len(h)))
        if (long > LONG_LIST + 1).any():
            h, n, node = h[order], n[order], node[order]
            first = np.repeat(begins, long)
            tied = np.arange(len(h)) - first > LONG_LIST
            h[tied], n[tied], node[tied] = node[tied], -1, node[first[tied]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, n, node)], ["h", "n", "node"])


def _read_lists(percent: int):
    """Pairs ``a, b`` of each short list with the meetings they need; ties, which need none."""

    def read(h: np.ndarray, n: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """``h, n, node`` in order, lists whole."""
        begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        long = np.diff(np.append(begins, len(h)))
        ends, length = np.repeat(begins + long, long), np.repeat(long, long)
        hot = np.flatnonzero(length > LONG_LIST)
        made = [(node[hot], node[np.repeat(begins, long)[hot]], np.zeros(len(hot), np.int64))]
        at = np.flatnonzero(length <= LONG_LIST)
        for d in range(1, LONG_LIST):
            at = at[at + d < ends[at]]
            # Sorted by size: what is too large here is too large for all that follow.
            at = at[n[at + d] <= 100 * n[at] // percent]
            if not len(at):
                break
            made.append((node[at], node[at + d], np.minimum(meetings(n[at]), -(-percent * n[at + d] // 100))))
        a, b, need = (np.concatenate(x) for x in zip(*made))
        apart = a != b
        return [np.minimum(a, b)[apart], np.maximum(a, b)[apart], need[apart]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, tied_to = 0, None  # the list that goes on and its first, if it was long already

        def given(a, b, need) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, need)], ["a", "b", "need"])

        for last, batch in _and_last(batches):
            if batch is not None:
                h, n, node = (batch.column(c).to_numpy() for c in ("h", "n", "node"))
                ties = n < 0
                if ties.any():
                    yield given(np.minimum(h, node)[ties], np.maximum(h, node)[ties], np.zeros(int(ties.sum()), np.int64))
                    h, n, node = h[~ties], n[~ties], node[~ties]
                held.append([h, n, node])
                rows += len(h)
            if rows < READ_ROWS and not last or not rows:
                continue
            h, n, node = (np.concatenate(x) for x in zip(*held))
            if tied_to and h[0] == tied_to[0]:
                same = int(np.searchsorted(h != tied_to[0], True))
                yield given(np.minimum(node[:same], tied_to[1]), np.maximum(node[:same], tied_to[1]), np.zeros(same, np.int64))
                h, n, node = h[same:], n[same:], node[same:]
            cut = len(h) if last else int(np.flatnonzero(h != h[-1])[-1]) + 1 if len(h) and h[0] != h[-1] else 0
            if cut:
                yield given(*read(h[:cut], n[:cut], node[:cut]))
            h, n, node = h[cut:], n[cut:], node[cut:]
            if len(h) > LONG_LIST:
                tied_to = (h[0], node[0])
                yield given(np.minimum(node[1:], node[0]), np.maximum(node[1:], node[0]), np.zeros(len(h) - 1, np.int64))
                h, n, node = h[:0], n[:0], node[:0]
            held, rows = [[h, n, node]], len(h)

    return run


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that leave every linked pair of different sets in one component."""
    postings = sets.filter("n > 0").select("node", "n", "prefix").mapInArrow(returning(_send_postings), "h long, n long, node long")
    lists = postings.repartition("h").sortWithinPartitions("h", "n", "node")
    met = lists.mapInArrow(returning(_read_lists(percent)), "a long, b long, need long")
    often = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).filter("met >= need")
    return often.select("a", "b")


def links_in_block(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets, as edges of a forest. Sets come ordered by size.

    Shingles that all or only one of the sets hold need no index: the first add a constant, the
    others nothing. Sets that agree in all indexed shingles share one look-up.
    """
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    everywhere = int((df == len(sets)).sum())
    use = (df > 1) & (df < len(sets))
    renumber = np.cumsum(use) - 1
    keep = use[inverse]
    owner, inverse = owner[keep], renumber[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    index, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=int(use.sum())))])
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    answers: dict[bytes, np.ndarray] = {}
    left, right = [], []
    for i in range(len(sets) - 1):
        own = inverse[bounds[i] : bounds[i + 1]]
        key = own.tobytes()
        overlap = answers.get(key)
        if overlap is None:
            lengths = first[own + 1] - first[own]
            places = np.repeat(first[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            overlap = np.bincount(index[places], minlength=len(sets)) + everywhere
            if len(answers) < 64:
                answers[key] = overlap
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        other = np.arange(i + 1, max(end, i + 1))
        both = overlap[other]
        hit = other[100 * both >= percent * (sizes[i] + sizes[other] - both)]
        left.append(np.full(len(hit), i))
        right.append(hit)
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    made = np.array(forest(a, b), int).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _verified(docs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` inside the candidate groups ``node, component, n``, as forests.

    ``row`` and ``digest`` of ``groups`` find a text that has the node's set. Of repeated rows a task
    passes on one. A group that fits a block is one; sets of larger groups are dealt out by size.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    # A set meets those of its own class of sizes and of the next one.
    side = lambda of, own: F.struct(of.cast("long").alias("class"), F.lit(own).alias("own"))
    fits = (F.col("sets") <= BLOCK_ROWS) & (F.col("shingles") <= BLOCK_SHINGLES)
    sides = F.when(fits, F.array(side(F.lit(0), 1))).otherwise(F.array(side(size_class, 1), side(size_class - 1, 0)))
    whole = groups.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    placed = groups.join(whole, "component").select("node", "n", "component", F.inline(sides))
    crowd = placed.groupBy("component", "class").agg(F.count("*").alias("c"), F.sum("n").alias("all"), F.sum("own").alias("own"))
    # Sets of the next class alone meet in their own class.
    crowd = crowd.filter("c > 1 AND own > 0").drop("own")
    placed = placed.drop("own")
    placed = placed.join(crowd, ["component", "class"])
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("all") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = placed.select("node", "n", "component", "class", F.explode(pairs).alias("pair"))
    block = F.xxhash64("component", "class", "pair")  # a collision only joins two blocks
    dealt_to = placed.groupBy("node", "n").agg(F.collect_set(block).alias("blocks")).drop("n")
    wanted = stored(groups.select("node", "n", "row", "digest").join(dealt_to, "node"))
    rows = with_may_match(docs.select(_row_key().alias("row"), "text"), F.col("row"), F.col("row"), wanted, "may").filter("may").select("row", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for key, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                this = (key, xxhash.xxh3_128_digest(text or ""))
                keep.append(this not in seen)
                seen.add(this)
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = rows.mapInArrow(returning(once), "row long, text string").join(wanted, "row")
    dealt = texts.select(F.explode("blocks").alias("block"), "node", "n", "digest", "text")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "n", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, nodes, sets_ = Shingler(k), None, [], []

        def done() -> pa.RecordBatch:
            a, b = links_in_block(sets_, percent) if len(sets_) > 1 else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

        for part in (part for batch in batches for part in slices(batch)):
            columns = (part.column(c).to_pylist() for c in ("block", "node", "digest", "text"))
            for key, node, digest, text in zip(*columns):
                if key != now:
                    yield done()
                    now, nodes, sets_ = key, [], []
                elif nodes and node == nodes[-1]:  # a repeated row
                    continue
                found = shingler.shingles(text)
                if xxhash.xxh3_128_digest(found.tobytes()) == digest:  # else another row with this key
                    nodes.append(node)
                    sets_.append(found)
        yield done()

    return dealt.select("block", "node", "digest", "text").mapInArrow(returning(verify), "a long, b long")


def _labelled(docs: DataFrame, k: int, percent: int, sample_rows: int) -> DataFrame:
    """``doc_id, row, n, first_id, first_row`` of each row of ``docs``.

    ``first`` is the row with the least id (null ids last) and key that links reach.
    """
    sets = stored(set_table(docs, k, percent, sample_rows))
    # Rows are nodes by what they hold: rows with equal sets are one, whatever their ids.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "n", "prefix"))
    best = sets.groupBy("digest").agg(first.alias("r"))
    unique = stored(best.select(F.monotonically_increasing_id().alias("node"), "digest", "r.*"))
    near = components(_candidates(unique, percent), LISTED_SETS)
    groups = stored(near.join(unique.select("node", "n", "row", "digest"), "node"))
    joined = components(_verified(docs, groups, k, percent))
    classes = unique.select("digest", "node", "unnamed", "doc_id", "row", "n").join(joined, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    firsts = classes.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "row")).alias("f"))
    firsts = firsts.select("component", F.col("f.doc_id").alias("first_id"), F.col("f.row").alias("first_row"))
    # Sets without shingles are linked with nothing: each such row is its own first.
    found = classes.filter("n > 0").join(firsts, "component").select("digest", "first_id", "first_row")
    worded = sets.filter("n > 0").select("doc_id", "row", "n", "digest").join(found, "digest").drop("digest")
    alone = sets.filter("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"))
    return worded.unionAll(alone)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z folded; a set holds the distinct ``k``-word
    shingles, or the whole sequence where there are fewer words. Two rows link when
    100 * intersection >= ``percent`` * union. A component carries its least id. Texts without words,
    null ones included, link with nothing. Each row counts with its own text: rows that repeat an id
    are linked by their texts alone, and so are rows with a null id, whose component is null if none
    of its rows has an id. Ids must be integers; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = _labelled(docs, k, percent, sample_rows)
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the least id, null ids last.

    Of rows that repeat this id and text one stays, chosen by a hash of its plain columns. Texts
    without words, null ones included, all stay.
    """
    rows = _labelled(docs, k, percent, sample_rows).filter("n > 0")
    stays = (F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    counted = rows.groupBy(F.col("doc_id").alias("_of_id"), F.col("row").alias("_of_row"), stays.alias("_stays")).agg(F.count("*").alias("_times"))
    # Rows that go, and those that stay but repeat.
    marked = stored(counted.filter("NOT _stays OR _times > 1").drop("_times"))
    same = lambda side: (F.col("_row_key") == side["_of_row"]) & F.col("_id_key").eqNullSafe(side["_of_id"])
    keyed = docs.withColumns({"_row_key": _row_key(), "_id_key": F.col("doc_id").cast("long")})
    may_match = lambda side: with_may_match(keyed, F.col("_row_key"), F.col("_of_row"), side, "_may_match")
    may_go = may_match(marked)
    kept = may_go.filter("NOT _may_match").select(*docs.columns)
    kept = kept.unionAll(may_go.filter("_may_match").join(marked, same(marked), "left_anti").select(*docs.columns))
    repeats = marked.filter("_stays")
    plain = [c for c, t in docs.dtypes if not any(x in t for x in ("map<", "variant"))]
    chosen = F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("_chosen")
    once = may_match(repeats).filter("_may_match").join(repeats, same(repeats)).groupBy("_row_key", "_id_key").agg(chosen)
    return kept.unionAll(once.select("_chosen.*"))
