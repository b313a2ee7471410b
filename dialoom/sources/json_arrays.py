"""Files that are each one JSON array of objects, in any layout, read by many tasks.

Spark's text reader cuts a file at every closing brace, wherever its splits lie, so no layout is
needed to find places to cut. What a split cannot know is whether it begins inside a string and how
deep. A first pass therefore walks each split under both answers and notes how it ends and which
depths it returns to; following the splits of a file in order then gives the state in front of each.
With that, whole records are cut out of every split, and the pieces of records that reach over the
end of a split are put together by the split they begin in.

Between the passes there is one narrow row per split. Records carry ``idx``, their place in the order
of files (by path) and of records in them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.operators.ranking import prefix_sums
from dialoom.session import broadcast_if_bounded, freeze

STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)
# What stands between the records of an array, and what closes one.
BEFORE = r"^\uFEFF?[ \t\r\n]*[,\[][ \t\r\n]*(?=\{)"
CLOSING = r"^\uFEFF?[ \t\r\n]*\[?[ \t\r\n]*\][ \t\r\n]*\}$"
RECORD = re.compile(BEFORE.replace("[,\\[]", "([,\\[])"))

ENDS = "_file string, _start long, _first long, pieces long, out string, within string"
STATES = "_file string, _start long, _first long, head long, tail long, began long, ends long, reached boolean"


def scan(piece: str, inside: bool) -> tuple[int, bool]:
    """Change of depth over a piece, without the brace that ends it, and whether a string is open."""
    bare = STRING.sub("", f'"{piece}' if inside else piece)
    cut = bare.find('"')
    if cut >= 0:
        bare = bare[:cut]
    return bare.count("{") + bare.count("[") - bare.count("]"), cut >= 0


class Walk:
    """Depths along a split, relative to its beginning, given whether that lies inside a string."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.depth = inside, 0
        self.depths: dict[int, list[int]] = {}  # first and last piece that end there, and how many

    def add(self, piece: str, number: int) -> None:
        delta, self.inside = scan(piece, self.inside)
        self.depth += delta
        if not self.inside:
            self.depth -= 1
            seen = self.depths.setdefault(self.depth, [number, number, 0])
            seen[1] = number
            seen[2] += 1

    def found(self) -> str:
        return json.dumps([self.inside, self.depth, self.depths])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: how it goes on from either state."""
    for (file, start), rows in groupby(_rows(batches), itemgetter(0, 1)):
        out, within, first, n = Walk(False), Walk(True), None, 0
        for n, (_, _, line, piece) in enumerate(rows, 1):
            first = line if first is None else first
            out.add(piece, n)
            within.add(piece, n)
        values = [[file], [start], [first], [n], [out.found()], [within.found()]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, values)), ["_file", "_start", "_first", "pieces", "out", "within"])


def _states(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file in order: how many pieces belong to the record that is open in front
    (``head``, its split ``began``), behind which the last record ends (``tail``), how many records
    end here and whether any does (``reached``). A split that reaches no end lies in one record.
    """
    splits = splits.sort_values("_start")
    file = splits["_file"].iloc[0]
    inside, depth, began, rows = False, 0, None, []
    for split in splits.to_dict("records"):
        ends_inside, delta, depths = json.loads(split["within"] if inside else split["out"])
        first, last, ends = depths.get(str(1 - depth), (split["pieces"], split["pieces"], 0))
        if not ends and began is None:
            first = last = 0
        rows.append((file, split["_start"], split["_first"], 0 if began is None else first, last, began, ends, ends > 0))
        if ends or began is None:
            began = split["_start"]
        inside, depth = ends_inside, depth + delta
    # A closing bracket is the last piece of a file, which no brace follows: one too many was counted.
    if inside or depth != -1:
        raise ValueError(f"not a JSON array of objects: {file}")
    made = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in STATES.split(", ")])
    return made.astype({"began": "Int64"})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in one split, from rows ``file, start, base, opens, piece``."""
    for (file, start), rows in groupby(_rows(batches), itemgetter(0, 1)):
        values, places, parts, level, inside, n = [], [], [], 0, False, 0
        for _, _, base, opens, piece in rows:
            if not parts:
                found = RECORD.match(piece)
                if not found or (found[1] == "[") != (opens and n == 0):
                    raise ValueError(f"not a JSON array of objects: {file}")
                piece = piece[found.end() :]
            delta, inside = scan(piece, inside)
            level += delta - (not inside)
            parts += (piece, "}")
            if level == 0 and not inside:
                values.append("".join(parts))
                places.append(base + n)
                parts, n = [], n + 1
                if len(values) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(places, pa.int64())], ["value", "idx"])
                    values, places = [], []
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(places, pa.int64())], ["value", "idx"])


def scan_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value, idx``: every record of the arrays under ``path`` as its JSON text.

    Files are read three times: to walk them, to cut out whole records, and, without looking into
    them, for the pieces at the ends of splits. A file that is no array of objects fails the job.
    """
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    walked = pieces.mapInArrow(_walk, ENDS)
    states = freeze(walked.groupBy("_file").applyInPandas(_states, STATES))
    offsets = prefix_sums(states, ["_file", "_start"], "ends", "offset")
    known = broadcast_if_bounded(offsets, offsets.count())  # one row per split
    at = F.col("_line") - F.col("_first")
    placed = pieces.join(known, ["_file", "_start"]).withColumn("_at", at)
    headless = F.col("began").isNull()

    whole = placed.filter((F.col("_at") >= F.col("head")) & (F.col("_at") < F.col("tail")))
    base = F.col("offset") + F.when(headless, 0).otherwise(1)
    records = whole.select("_file", "_start", base.alias("base"), headless.alias("opens"), "value").mapInArrow(
        _cut, "value string, idx long"
    )

    in_head = F.col("_at") < F.col("head")
    over = placed.filter(in_head | (F.col("_at") >= F.col("tail"))).select(
        "_file",
        F.when(in_head, F.col("began")).otherwise(F.col("_start")).alias("_begins"),
        F.when(in_head & F.col("reached"), F.col("offset")).alias("idx"),
        F.struct("_start", "_at", "value").alias("_piece"),
    )
    joined = over.groupBy("_file", "_begins").agg(
        F.max("idx").alias("idx"), F.sort_array(F.collect_list("_piece"))["value"].alias("_parts")
    )
    joined = joined.withColumn("value", F.concat(F.array_join("_parts", "}"), F.lit("}")))
    other = F.raise_error(F.concat(F.lit("not a JSON array of objects: "), F.col("_file"))).cast("boolean")
    stitched = joined.filter(~F.col("value").rlike(CLOSING)).filter(
        F.when(F.col("value").rlike(BEFORE) & F.col("idx").isNotNull(), True).otherwise(other)
    )
    stitched = stitched.select(F.regexp_replace("value", BEFORE, "").alias("value"), "idx")
    return records.unionByName(stitched)
