"""Readers for conversation files, and the normalisation of loosely shaped records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from dialoom.functions.turns import falls_through
from dialoom.schema import CONVERSATION

# A record boundary in a JSON array written with two-space indentation: raw line breaks
# cannot occur inside JSON strings and nested closers are indented further.
INDENTED_BOUNDARY = "\n  },\n"


Schema = T.StructType | str | None


def _json_reader(spark: SparkSession, schema: Schema) -> DataFrameReader:
    reader = spark.read.option("mode", "FAILFAST")
    return reader if schema is None else reader.schema(schema)


def scan_conversations_jsonl(
    spark: SparkSession, path: str, schema: Schema = CONVERSATION
) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails the job.

    Keys outside ``schema`` are not read. ``schema=None`` keeps every key, at the price of a
    pass over the data to find them.
    """
    return _json_reader(spark, schema).json(path)


def scan_records_variant(spark: SparkSession, path: str) -> DataFrame:
    """JSONL read without a schema: one VARIANT column ``record`` that loses nothing."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("record"))


def scan_conversations_json(
    spark: SparkSession,
    path: str,
    schema: Schema = CONVERSATION,
    layout: str = "any",
) -> DataFrame:
    """Files that are each one JSON array of records.

    ``any`` parses every file as a whole, one task per file. ``array`` reads any spelling with many
    tasks, in three passes (``json_arrays``). ``indented`` is for arrays
    written with two-space indentation and LF: such a file is cut at record boundaries, so one
    big file is read by many tasks. A piece that holds anything but one record, as any other
    spelling gives, fails the job.
    """
    if layout == "any":
        return _json_reader(spark, schema).option("multiLine", True).json(path)
    if layout not in ("array", "indented"):
        raise ValueError(f"unknown layout: {layout}")
    if schema is None:
        raise ValueError(f"layout='{layout}' needs a schema")
    if layout == "array":
        from dialoom.sources.json_arrays import scan_array_records

        parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
        return scan_array_records(spark, path).select(parsed.alias("r")).select("r.*")
    pieces = spark.read.option("lineSep", INDENTED_BOUNDARY).text(path)
    # The first piece of a file opens the array and the last one closes it; the others
    # lost their closing brace to the separator.
    opened = F.regexp_replace("value", r"^\s*\[\s*(?=\{|\]|$)", "")
    last = opened.rlike(r"(^|\n)\]\s*$")
    body = F.when(last, F.regexp_replace(opened, r"\s*\]\s*$", "")).otherwise(
        F.concat(opened, F.lit("\n  }"))
    )
    record = F.from_json(F.col("body"), schema, {"mode": "FAILFAST"})
    other = F.raise_error(F.lit("not a two-space indented array of records")).cast("boolean")
    # One record: it opens with two spaces less than its keys, ends with its own closer, and has
    # no other line that closes a record or the array.
    one = F.col("body").rlike(r"^\{\n    (?s:.*)\n  \}$") & ~F.col("body").rlike(r"\n {0,2}[\]}],?\n")
    return (
        pieces.select(F.btrim(body, F.lit(" \t\n\r")).alias("body"))
        .filter(F.col("body") != "")
        .filter(F.when(one, True).otherwise(other))
        .select(record.alias("r"))
        .select("r.*")
    )


def scan_parquet_dir(spark: SparkSession, directory: str) -> DataFrame:
    """All ``*.parquet`` files directly inside ``directory``."""
    return (
        spark.read.option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", False)
        .option("mergeSchema", False)
        .parquet(directory)
    )


def format_of(path: str, fmt: str | None = None) -> str:
    """``fmt``, else the suffix of the path, else what its name stands for."""
    if fmt is None:
        suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]
        if suffix in ("jsonl", "json", "parquet"):
            fmt = suffix
        elif "ultra" in path:  # the one data set that is known by its name
            fmt = "parquet"
    if fmt not in ("jsonl", "json", "parquet"):
        raise ValueError(f"unsupported conversation format: {fmt or path}")
    return fmt


def load_conversations(
    spark: SparkSession, path: str, fmt: str | None = None, schema: Schema = CONVERSATION
) -> DataFrame:
    """Pick the reader by ``fmt``, else by the suffix of the path, else by its name.

    ``schema`` is for JSON; Parquet files bring their own. With one, arrays are read by many tasks.
    """
    fmt = format_of(path, fmt)
    if fmt == "parquet":
        return scan_parquet_dir(spark, path)
    if fmt == "jsonl":
        return scan_conversations_jsonl(spark, path, schema)
    return scan_conversations_json(spark, path, schema, "any" if schema is None else "array")


def scan_text_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as text lines in column ``value``."""
    return spark.read.text(path)


def union_all_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of all inputs, duplicates kept; a column absent in one input is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coalesce_turn_fields(df: DataFrame) -> DataFrame:
    """Records under any accepted spelling to ``conversations: array<from, value>``.

    An empty ``conversations`` gives way to ``items`` if the record has one, else to
    ``messages``; an empty ``from``/``value`` gives way to ``role``/``content``.
    """
    there = [c for c in ("conversations", "items", "messages") if c in df.columns]

    def unified(container: str) -> Column:
        """A container under the canonical names, whatever names its own turns have."""
        fields = set(df.schema[container].dataType.elementType.names)

        def first_of(turn: Column, *names: str) -> Column:
            found = [turn[n] for n in names if n in fields]
            return falls_through(*found) if found else F.lit(None).cast("string")

        return F.transform(
            container,
            lambda t: F.struct(
                first_of(t, "from", "role").alias("from"),
                first_of(t, "value", "content").alias("value"),
            ),
        )

    choices = [
        F.when(F.size(c) > 0, unified(c)) if c == "conversations" else unified(c) for c in there
    ]
    turns = F.coalesce(*choices)
    kept = [c for c in df.columns if c not in ("conversations", "items", "messages")]
    empty = F.expr("CAST(array() AS array<struct<`from`:string,value:string>>)")
    return df.select(*kept, F.coalesce(turns, empty).alias("conversations"))


def _present(record: Column, path: str) -> Column:
    """Whether a key is there at all, with a null value or not."""
    return F.variant_get(record, path, "variant").isNotNull()


def default_id(df: DataFrame, idx: str = "idx", record: str = "record") -> DataFrame:
    """Add ``id`` from a VARIANT record: ``regenerated_{idx}`` only where the key is absent.

    A key that is present with a null value stays null.
    """
    rec = F.col(record)
    made_up = F.concat(F.lit("regenerated_"), F.col(idx).cast("string"))
    return df.withColumn(
        "id",
        F.when(_present(rec, "$.id"), F.variant_get(rec, "$.id", "string")).otherwise(made_up),
    )


def content_text(v: Column) -> Column:
    """A VARIANT message body as text.

    Text stays; text blocks are joined; a list of strings is joined by line breaks;
    anything else becomes its JSON text.
    """
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")

    def is_block(item: Column) -> Column:
        return F.coalesce(_present(item, "$.type") & _present(item, "$.text"), F.lit(False))

    is_list = F.coalesce(kind.startswith("ARRAY<"), F.lit(False))
    blocks = is_list & F.coalesce(F.forall(items, is_block), F.lit(False))
    block_text = F.array_join(
        F.transform(items, lambda i: F.coalesce(F.variant_get(i, "$.text", "string"), F.lit(""))),
        "",
    )
    strings = F.try_variant_get(v, "$", "array<string>")
    return (
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind == "ARRAY<STRING>", F.array_join(strings, "\n"))
        .when(blocks, block_text)
        .otherwise(F.to_json(v))
    )


def normalize_content(df: DataFrame, column: str) -> DataFrame:
    """Replace a VARIANT message body by text (``content_text``)."""
    return df.withColumn(column, content_text(F.col(column)))


def conversations_from_variant(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``conversations`` from whole records of any accepted spelling, bodies as text.

    The record itself stays beside it, so no key is lost; ``default_id`` adds the id. Containers
    and fields give way to each other as in ``coalesce_turn_fields``.
    """
    rec = F.col(record)
    found = [F.try_variant_get(rec, f"$.{c}", "array<variant>") for c in ("conversations", "items", "messages")]
    container = F.coalesce(F.when(F.size(found[0]) > 0, found[0]), *found[1:])

    def turn(t: Column) -> Column:
        speaker = falls_through(*[F.try_variant_get(t, f"$.{n}", "string") for n in ("from", "role")])
        own, other = (F.variant_get(t, f"$.{n}", "variant") for n in ("value", "content"))
        value = falls_through(content_text(own), content_text(other))
        return F.struct(speaker.alias("from"), value.alias("value"))

    empty = F.expr("CAST(array() AS array<struct<`from`:string,value:string>>)")
    return df.withColumn("conversations", F.coalesce(F.transform(container, turn), empty))
