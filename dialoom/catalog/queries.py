"""Every operator as a query over the given tables, next to the SQL that must agree with it.

Nested results are flattened to plain columns so that both sides can be compared by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dialoom.catalog import inputs, sql
from dialoom.catalog.inputs import TOKENIZER, table
from dialoom.functions.hashing import hex_threshold
from dialoom.functions.text import GEMMA, LLAMA
from dialoom.operators import features as feat
from dialoom.operators import metrics, records, regenerate, sampling, vocabulary
from dialoom.operators import turn_table as tt
from dialoom.operators.ranking import rank_by_order
from dialoom.plans import jobs
from dialoom.schema import CONVERSATION, LOOSE_CONVERSATION, MAX_LEN
from dialoom.session import fresh_path
from dialoom.sources import conversations as src
from dialoom.sources import in_order as ordered
from dialoom.sources import sinks
from dialoom.streaming import conversations as closing
from dialoom.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DRAFT_SIZE = 500


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _flat(nested: DataFrame) -> DataFrame:
    """Nested records as ``id, pos, speaker, value``."""
    turns = tt.explode_turns(nested).filter(F.col("pos").isNotNull())
    return turns.select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("from").alias("speaker"), "value"
    )


def _turns(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.select(
        "id", F.col(pos).cast("bigint").alias("pos"), F.col("from").alias("speaker"), "value"
    )


def _rounded(column: str) -> Column:
    """Six digits, nudged so that a mean ending in 5 goes the same way on every engine."""
    return F.round(F.col(column) + F.lit(1e-9), 6)


def _text(values: str, sep: str = " ") -> Column:
    return F.array_join(F.col(values).cast("array<string>"), sep)


# --- sources and sinks ------------------------------------------------------------------


def _jsonl(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "conversations") + ".jsonl"
    sinks.write_jsonl(inputs.records(spark, sf_dir), path)
    return path


def _json_arrays(spark: SparkSession, sf_dir: str, indented: bool) -> str:
    """Files that are each one JSON array of up to 200 records."""
    path = fresh_path(spark, "conversations") + ".json"
    number = F.substring_index("id", "_", -1).cast("bigint")
    conv = inputs.records(spark, sf_dir).withColumn("bucket", F.floor(number / 200))
    one = F.to_json(F.struct("id", "conversations"))
    if indented:
        body = F.to_json("conversations")
        one = F.concat(
            F.lit('  {\n    "id": "'), F.col("id"), F.lit('",\n    "conversations": '), body,
            F.lit("\n  }"),
        )
    sep, ends = (",\n", ("[\n", "\n]")) if indented else (", ", ("[", "]"))
    arrays = conv.groupBy("bucket").agg(
        F.concat(F.lit(ends[0]), F.array_join(F.collect_list(one), sep), F.lit(ends[1])).alias("value")
    )
    arrays.write.partitionBy("bucket").text(path)
    return path


RAW_TURNS_SQL = f"WITH {sql.TURNS} SELECT id, pos, speaker, value FROM turns"


@query("scan_conversations_jsonl", RAW_TURNS_SQL)
def scan_conversations_jsonl(spark, sf_dir):
    return _flat(src.scan_conversations_jsonl(spark, _jsonl(spark, sf_dir), CONVERSATION))


@query("scan_conversations_json", RAW_TURNS_SQL)
def scan_conversations_json(spark, sf_dir):
    return _flat(src.scan_conversations_json(spark, _json_arrays(spark, sf_dir, False), CONVERSATION))


@query("scan_conversations_json_array", RAW_TURNS_SQL)
def scan_conversations_json_array(spark, sf_dir):
    path = _json_arrays(spark, sf_dir, False)
    return _flat(src.scan_conversations_json(spark, path, CONVERSATION, layout="array"))


@query(
    "load_in_order",
    """WITH numbered AS (
      SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx
      FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT fmt, 'sharegpt_' || conv_id AS id, idx
    FROM numbered, (VALUES ('jsonl'), ('json'), ('parquet')) f(fmt)""",
)
def load_in_order(spark, sf_dir):
    """The conversations in order, 100 to a file; every format read back with the places."""
    number = F.substring_index("id", "_", -1).cast("bigint").alias("number")
    conv = inputs.records(spark, sf_dir).select(number, "id", "conversations")
    conv = conv.withColumn("file", F.format_string("%09d", F.floor(F.col("number") / 100)))
    dealt = conv.repartition("file").sortWithinPartitions("file", "number")
    listed = F.sort_array(F.collect_list(F.struct("number", F.to_json(F.struct("id", "conversations")).alias("one"))))
    arrays = conv.groupBy("file").agg(
        F.concat(F.lit("["), F.array_join(listed["one"], ",\n"), F.lit("]")).alias("value")
    )
    root, read = fresh_path(spark, "ordered"), []
    # Several files to one folder; the arrays keep a folder for each, which makes part of its path.
    dealt.select("id", "conversations", "file").write.partitionBy("file").json(f"{root}/jsonl")
    arrays.write.partitionBy("file").text(f"{root}/json")
    dealt.repartitionByRange(4, "number").sortWithinPartitions("number").write.parquet(f"{root}/parquet")
    for fmt in ("jsonl", "json", "parquet"):
        rows = ordered.load_in_order(spark, f"{root}/{fmt}", fmt, CONVERSATION)
        read.append(rows.select(F.lit(fmt).alias("fmt"), "id", "idx"))
    return src.union_all_files(read)


@query("scan_conversations_json_indented", RAW_TURNS_SQL)
def scan_conversations_json_indented(spark, sf_dir):
    path = _json_arrays(spark, sf_dir, True)
    return _flat(src.scan_conversations_json(spark, path, CONVERSATION, layout="indented"))


def _parquet(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "ultra")
    inputs.records(spark, sf_dir).write.parquet(path)
    return path


@query("scan_parquet_dir", RAW_TURNS_SQL)
def scan_parquet_dir(spark, sf_dir):
    return _flat(src.scan_parquet_dir(spark, _parquet(spark, sf_dir)))


@query(
    "load_conversations",
    f"""WITH {sql.TURNS}
    SELECT fmt, count(DISTINCT id) AS records, count(*) AS turns
    FROM turns, (VALUES ('parquet'), ('jsonl'), ('json')) f(fmt) GROUP BY fmt""",
)
def load_conversations(spark, sf_dir):
    paths = {
        "parquet": _parquet(spark, sf_dir),
        "jsonl": _jsonl(spark, sf_dir),
        "json": _json_arrays(spark, sf_dir, False),
    }
    loaded = [
        src.load_conversations(spark, path).select(F.lit(fmt).alias("fmt"), "conversations")
        for fmt, path in paths.items()
    ]
    return src.union_all_files(loaded).groupBy("fmt").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.size("conversations")).alias("turns"),
    )


LOG_LINES_SQL = f"""
WITH {sql.STEPS},
lines AS (
  SELECT split || ' Epoch [' || epoch || '/40], position ' || position || ',  ' || metric
         || ': ' || printf('%.2f', value) AS value, event_id FROM steps),
noisy AS (
  SELECT value FROM lines
  UNION ALL SELECT 'progress 10% ' || value FROM lines WHERE event_id % 11 = 0)"""


@query("scan_text_log", LOG_LINES_SQL + " SELECT value, count(*) AS lines FROM noisy GROUP BY value")
def scan_text_log(spark, sf_dir):
    path = fresh_path(spark, "log")
    inputs.log_lines(spark, sf_dir).write.text(path)
    return src.scan_text_log(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "write_jsonl",
    f"""WITH {sql.TURNS} SELECT '{{"id":"' || id || '","note":' ||
       CASE WHEN conv_id % 2 = 0 THEN '"été"' ELSE 'null' END || ',"conversations":[' ||
       string_agg('{{"from":' || to_json(speaker) || ',"value":' || to_json(value) || '}}', ','
                  ORDER BY pos) || ']}}' AS value
    FROM turns GROUP BY id, conv_id""",
)
def write_jsonl(spark, sf_dir):
    path = fresh_path(spark, "notes")
    conv = inputs.records(spark, sf_dir)
    even = F.substring_index("id", "_", -1).cast("bigint") % 2 == 0
    note = F.when(even, "été").alias("note")
    sinks.write_jsonl(conv.select("id", note, "conversations"), path)
    return spark.read.text(path)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue records with ``idx``, their place in the order of conversation numbers."""
    conv = inputs.dialogue_records(spark, sf_dir)
    number = F.substring_index("id", "_", -1).cast("bigint")
    ranked = rank_by_order(conv.withColumn("conv_id", number), "conv_id")
    return ranked.withColumnRenamed("rank", "idx").drop("n_rows", "conv_id")


INDEXED_SQL = f"""WITH {sql.DIALOGUE},
indexed AS (
  SELECT id, row_number() OVER (ORDER BY conv_id) - 1 AS idx
  FROM (SELECT DISTINCT id, conv_id FROM dialogue)),
spoken AS (
  SELECT id, idx, ord AS pos, speaker, value FROM indexed JOIN dialogue USING (id))"""


def _spoken(rows: DataFrame, *more: str) -> DataFrame:
    """Indexed records as whole turns."""
    flat = tt.explode_turns(rows).filter(F.col("pos").isNotNull())
    return flat.select("id", "idx", *more, "pos", F.col("from").alias("speaker"), "value")


@query(
    "write_batches",
    INDEXED_SQL + """
    SELECT CAST(floor((idx - 5) / 16.0) * 16 + 5 AS BIGINT) AS batch_start, *
    FROM spoken""",
)
def write_batches(spark, sf_dir):
    path = fresh_path(spark, "batches")
    sinks.write_batches(_indexed(spark, sf_dir), path, 16, start_index=5)
    return _spoken(sinks.scan_batches(spark, path), "batch_start")


@query(
    "merge_batches",
    INDEXED_SQL + """
    SELECT *, CAST(floor(idx / 10.0) * 10 AS BIGINT)
           + CASE WHEN idx % 3 = 0 THEN 1000 ELSE 0 END AS batch_start
    FROM spoken""",
)
def merge_batches(spark, sf_dir):
    path = fresh_path(spark, "batches")
    first = sinks.assign_batches(_indexed(spark, sf_dir), 10)
    again = first.filter("idx % 3 = 0").withColumn("batch_start", F.col("batch_start") + 1000)
    for save in (first, again, again):  # the second save was written twice
        save.write.mode("append").json(path)
    return _spoken(sinks.merge_batches(sinks.scan_batches(spark, path)), "batch_start")


@query("load_or_build_vocab", "WITH " + sql.top(DRAFT_SIZE) + """
    SELECT draft_id, token_id, token_id - draft_id AS "offset" FROM vocab""")
def load_or_build_vocab(spark, sf_dir):
    root = fresh_path(spark, "vocabulary")

    def load():
        return sinks.load_or_build_vocab(
            spark, root, lambda: _vocab(spark, sf_dir), data=sf_dir, draft_size=DRAFT_SIZE
        )

    load()
    return load()


@query(
    "record_counts",
    f"""WITH {sql.CLEANED},
    loaded AS (SELECT count(DISTINCT id) AS n FROM turns),
    filled AS (SELECT count(DISTINCT id) AS n FROM cleaned)
    SELECT 'loaded' AS stage, n AS records FROM loaded
    UNION ALL SELECT 'cleaned', n FROM filled
    UNION ALL SELECT 'train', CAST(floor(n * 0.95::DOUBLE) AS BIGINT) FROM filled
    UNION ALL SELECT 'test', n - CAST(floor(n * 0.95::DOUBLE) AS BIGINT) FROM filled
    UNION ALL SELECT 'merged', n FROM filled""",
)
def record_counts(spark, sf_dir):
    loaded = inputs.records(spark, sf_dir)
    cleaned = records.skip_empty(feat.cleaned_records(inputs.raw_turns(spark, sf_dir)))
    split = sampling.exact_split(cleaned.select("id"))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    return sinks.record_counts(
        loaded=loaded, cleaned=cleaned, train=train, test=test,
        merged=src.union_all_files([train, test]),
    )


# --- cleaning ---------------------------------------------------------------------------


@query("drop_trailing_human", f"WITH {sql.NO_TAIL} SELECT id, pos, speaker, value FROM no_tail")
def drop_trailing_human(spark, sf_dir):
    turns = inputs.dialogue(spark, sf_dir)
    return _turns(tt.drop_trailing_human(tt.numbered(turns)))


@query(
    "drop_trailing_empty_reply",
    "WITH " + sql.EMPTIED + sql.drop_empty_exchange("emptied", "kept")
    + " SELECT id, pos, speaker, value FROM kept",
)
def drop_trailing_empty_reply(spark, sf_dir):
    turns = inputs.emptied(spark, sf_dir)
    return _turns(tt.drop_trailing_empty_reply(tt.numbered(turns)))


CLEAN_SQL = "WITH " + sql.BLANKED + """,
headed AS (
  SELECT id, pos, speaker, value, ord, max(ord) OVER (PARTITION BY id) AS last
  FROM blanked WHERE NOT (ord = n - 1 AND speaker = 'human'))""" + sql.drop_empty_exchange(
    "headed", "kept"
)


@query("clean_conversations", CLEAN_SQL + " SELECT id, pos, speaker, value FROM kept")
def clean_conversations(spark, sf_dir):
    turns = inputs.blanked(spark, sf_dir)
    return _turns(tt.clean_conversations(tt.numbered(turns)))


@query(
    "clean_records",
    CLEAN_SQL + " SELECT id, ord AS pos, speaker, value FROM kept",
)
def clean_records(spark, sf_dir):
    return _flat(feat.cleaned_records(inputs.blanked(spark, sf_dir)))


@query(
    "clean_variant",
    CLEAN_SQL + " SELECT id, ord AS pos, speaker, value, 'note ' || id AS note FROM kept",
)
def clean_variant(spark, sf_dir):
    """Whole records of changing types, cleaned as VARIANT and written and read as lines."""
    conv = tt.collect_turns(inputs.blanked(spark, sf_dir))
    text = F.to_json(F.struct("id", F.concat(F.lit("note "), "id").alias("note"), "conversations"))
    path = fresh_path(spark, "variant")
    made = records.clean_variant(conv.select(F.parse_json(text).alias("record")))
    made.select(F.to_json("record").alias("value")).write.text(path)
    read = src.scan_conversations_jsonl(spark, path, T.StructType([*CONVERSATION.fields, T.StructField("note", T.StringType())]))
    flat = tt.explode_turns(read).filter(F.col("pos").isNotNull())
    return flat.select("id", "pos", F.col("from").alias("speaker"), "value", "note")


@query(
    "skip_empty",
    f"WITH {sql.CLEANED} SELECT id, count(*) AS turns FROM cleaned GROUP BY id",
)
def skip_empty(spark, sf_dir):
    filled = records.skip_empty(feat.cleaned_records(inputs.raw_turns(spark, sf_dir)))
    return filled.groupBy("id").agg(F.sum(F.size("conversations")).alias("turns"))


NUMBERED_SQL = f"""WITH {sql.TURNS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS ord FROM turns)"""


@query(
    "drop_leading_non_human",
    NUMBERED_SQL + """,
    led AS (SELECT id FROM numbered WHERE ord = 0 AND speaker <> 'human')
    SELECT id, ord - CASE WHEN id IN (SELECT id FROM led) THEN 1 ELSE 0 END AS ord, speaker, value
    FROM numbered WHERE NOT (ord = 0 AND speaker <> 'human')""",
)
def drop_leading_non_human(spark, sf_dir):
    turns = inputs.raw_turns(spark, sf_dir)
    return tt.drop_leading_non_human(tt.numbered(turns)).select(
        "id", "ord", F.col("from").alias("speaker"), "value"
    )


@query(
    "map_roles",
    f"""WITH {sql.TURNS} SELECT id, pos,
    CASE speaker WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'model' END AS role FROM turns""",
)
def map_roles(spark, sf_dir):
    return tt.map_roles(inputs.raw_turns(spark, sf_dir), "model", "quarantine").select(
        "id", "pos", "role"
    )


@query(
    "check_alternation",
    NUMBERED_SQL + """
    SELECT id, bool_and(speaker = CASE WHEN ord % 2 = 0 THEN 'human' ELSE 'gpt' END) AS alternates
    FROM numbered GROUP BY id""",
)
def check_alternation(spark, sf_dir):
    numbered = tt.number_turns(inputs.raw_turns(spark, sf_dir).drop("value"))
    return (
        tt.check_alternation(numbered, "quarantine").filter("ord = 0").select("id", "alternates")
    )


@query("coalesce_turn_fields", RAW_TURNS_SQL)
def coalesce_turn_fields(spark, sf_dir):
    """Records written under three spellings, by conversation number, and read back."""
    path = fresh_path(spark, "loose")
    conv = inputs.records(spark, sf_dir)
    kind = F.substring_index("id", "_", -1).cast("bigint") % 3
    plain = F.col("conversations")
    renamed = F.transform(
        plain, lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content"))
    )
    blank = F.transform(
        plain,
        lambda t: F.struct(
            F.lit("").alias("from"), t["from"].alias("role"), F.lit("").alias("value"),
            t["value"].alias("content"),
        ),
    )
    conv.select(
        "id",
        F.when(kind == 0, plain).otherwise(F.slice(plain, 1, 0)).alias("conversations"),
        F.when(kind == 1, renamed).alias("items"),
        F.when(kind == 2, blank).alias("messages"),
    ).write.json(path)
    loose = src.scan_conversations_jsonl(spark, path, LOOSE_CONVERSATION)
    return _flat(src.coalesce_turn_fields(loose))


@query(
    "keep_dialogue_roles",
    f"WITH {sql.DIALOGUE} SELECT id, pos, speaker, value FROM dialogue",
)
def keep_dialogue_roles(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("sharegpt_"), F.col("conv_id").cast("string")).alias("id"),
        F.col("turn").alias("pos"), F.col("role").alias("from"), F.col("text").alias("value"),
    )
    return _turns(tt.keep_dialogue_roles(raw))


@query(
    "default_id",
    f"""WITH {sql.TURNS}, numbered AS (
      SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx
      FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'regenerated_' || idx
         WHEN conv_id % 11 = 0 THEN NULL ELSE 'sharegpt_' || conv_id END AS id,
         pos, speaker, value
    FROM turns JOIN numbered USING (conv_id)""",
)
def default_id(spark, sf_dir):
    number = F.substring_index("id", "_", -1).cast("bigint").alias("conv_id")
    conv = inputs.records(spark, sf_dir).select(number, "conversations")
    ranked = rank_by_order(conv, "conv_id").withColumnRenamed("rank", "idx")
    c = F.col("conv_id")
    head = (
        F.when(c % 7 == 0, F.lit("{"))
        .when(c % 11 == 0, F.lit('{"id":null,'))
        .otherwise(F.concat(F.lit('{"id":"sharegpt_'), c.cast("string"), F.lit('",')))
    )
    text = F.concat(head, F.lit('"conversations":'), F.to_json("conversations"), F.lit("}"))
    parsed = src.default_id(ranked.withColumn("record", F.parse_json(text)))
    turns = F.variant_get("record", "$.conversations", "array<struct<from:string,value:string>>")
    flat = tt.explode_turns(parsed.select("conv_id", "id", turns.alias("conversations")))
    return flat.select("conv_id", "id", "pos", F.col("from").alias("speaker"), "value")


@query(
    "slice_by_index",
    INDEXED_SQL + " SELECT * FROM spoken WHERE idx >= 10 AND idx < 75",
)
def slice_by_index(spark, sf_dir):
    return _spoken(sampling.slice_by_index(_indexed(spark, sf_dir), 10, 75))


@query(
    "normalize_content",
    f"""WITH {sql.TURNS} SELECT id, pos, CASE pos % 4 WHEN 0 THEN value
      WHEN 1 THEN replace(value, ' ', chr(10)) WHEN 2 THEN replace(value, chr(10), '')
      ELSE CAST(conv_id + pos AS VARCHAR) END AS content
    FROM turns""",
)
def normalize_content(spark, sf_dir):
    mixed = _mixed_turns(spark, sf_dir).select("id", "pos", F.parse_json("body").alias("content"))
    return src.normalize_content(mixed, "content")


def _mixed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with ``body``: JSON of a string, a list of strings, text blocks or a number."""
    kind = F.col("pos") % 4
    v = F.col("value")
    blocks = F.transform(
        F.split(v, "\n"), lambda b: F.struct(F.lit("text").alias("type"), b.alias("text"))
    )
    # A JSON string literal: the value as the only element of an array, without the brackets.
    as_string = F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    body = (
        F.when(kind == 0, as_string)
        .when(kind == 1, F.to_json(F.split(v, " ")))
        .when(kind == 2, F.to_json(blocks))
        .otherwise((F.col("conv_id") + F.col("pos")).cast("string"))
    )
    return inputs.raw_turns(spark, sf_dir).withColumn("body", body)


MIXED_SQL = """CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', chr(10))
    WHEN 2 THEN replace(text, chr(10), '') ELSE CAST(conv_id + turn AS VARCHAR) END AS value"""


@query(
    "featurize_mixed_content",
    "WITH " + sql.masks(LLAMA, cap="").replace("text AS value", MIXED_SQL) + """
    SELECT id, string_agg(token_id::VARCHAR, ' ' ORDER BY t) AS ids,
           string_agg(bit::VARCHAR, '' ORDER BY t) AS mask
    FROM masks GROUP BY id""",
)
def featurize_mixed_content(spark, sf_dir):
    """Whole records of mixed bodies, read as VARIANT, to ids and masks without a cap."""
    spoken = F.concat(
        F.lit('{"role":'), F.regexp_extract(F.to_json(F.array("from")), r"^\[(.*)\]$", 1),
        F.lit(',"content":'), F.col("body"), F.lit("}"),
    )
    turns = _mixed_turns(spark, sf_dir).select("id", F.struct("pos", spoken.alias("t")).alias("s"))
    listed = turns.groupBy("id").agg(F.sort_array(F.collect_list("s"))["t"].alias("ts"))
    path = fresh_path(spark, "mixed")
    listed.select(
        F.concat(
            F.lit('{"id":"'), F.col("id"), F.lit('","note":7,"messages":['),
            F.array_join("ts", ","), F.lit("]}"),
        ).alias("value")
    ).write.text(path)
    read = src.conversations_from_variant(src.scan_records_variant(spark, path))
    named = src.default_id(read.withColumn("idx", F.lit(None).cast("bigint")))
    cleaned = records.clean_conversations(records.keep_dialogue_roles(named))
    rows = feat.featurize(cleaned.select("id", "conversations"), LLAMA, TOKENIZER)
    return rows.select("id", _text("input_ids").alias("ids"), _text("loss_mask", "").alias("mask"))


@query(
    "inject_system",
    f"""WITH {sql.DIALOGUE}
    SELECT id, ord + 1 AS ord, speaker, value FROM dialogue
    UNION ALL SELECT DISTINCT id, 0, 'system', 'Be brief.' FROM dialogue""",
)
def inject_system(spark, sf_dir):
    numbered = tt.number_turns(inputs.dialogue(spark, sf_dir))
    return tt.inject_system(numbered, "Be brief.").select(
        "id", "ord", F.col("from").alias("speaker"), "value"
    )


@query("explode_turns", RAW_TURNS_SQL)
def explode_turns(spark, sf_dir):
    return _flat(inputs.records(spark, sf_dir))


@query(
    "collect_turns",
    f"""WITH {sql.TURNS}
    SELECT id, count(*) AS turns, md5(string_agg(speaker || ':' || value, '|' ORDER BY pos)) AS digest
    FROM turns GROUP BY id""",
)
def collect_turns(spark, sf_dir):
    joined = F.array_join(
        F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "|"
    )
    return inputs.records(spark, sf_dir).select(
        "id", F.size("conversations").cast("bigint").alias("turns"), F.md5(joined).alias("digest")
    )


# --- text and features ------------------------------------------------------------------


@query(
    "build_prompts",
    f"""WITH {sql.DIALOGUE}
    SELECT r.id, r.ord AS pos, coalesce(string_agg(
             CASE e.speaker WHEN 'human' THEN 'Human: ' ELSE 'Assistant: ' END || e.value
             || chr(10) || chr(10), '' ORDER BY e.ord), '') || 'Assistant:' AS prompt
    FROM dialogue r LEFT JOIN dialogue e ON e.id = r.id AND e.ord < r.ord
    WHERE r.speaker = 'gpt' GROUP BY r.id, r.ord""",
)
def build_prompts(spark, sf_dir):
    prompts = records.build_prompts(inputs.dialogue_records(spark, sf_dir))
    return prompts.withColumn("pos", F.col("pos").cast("bigint"))


@query("transcripts", ORACLES["build_prompts"])
def transcripts(spark, sf_dir):
    """The same prompts, each expanded from its conversation's one transcript."""
    held = records.transcripts(inputs.dialogue_records(spark, sf_dir))
    replies = held.select("id", "transcript", F.explode("replies").alias("r"))
    prompt = records.prompt_at(F.col("transcript"), F.col("r.length"))
    return replies.select("id", F.col("r.pos").cast("bigint").alias("pos"), prompt.alias("prompt"))


def _render(template):
    def run(spark, sf_dir):
        return feat.chat_texts(inputs.trainable(spark, sf_dir), template).select("id", "text")

    return run


for _name, _template in (("render_chat", LLAMA), ("render_chat_gemma", GEMMA)):
    query(_name, f"WITH {sql.chats(_template)} SELECT id, text FROM chats")(_render(_template))


@query(
    "split_rounds",
    "WITH " + sql.masks(LLAMA) + f"""
    SELECT id, i, string_split(round, {sql.literal(LLAMA.reply_sep)})[1]
           || {sql.literal(LLAMA.reply_sep)} AS instruction,
           string_split(round, {sql.literal(LLAMA.reply_sep)})[2] AS reply
    FROM judged WHERE usable""",
)
def split_rounds(spark, sf_dir):
    texts = feat.split_rounds(feat.chat_texts(inputs.trainable(spark, sf_dir), LLAMA), LLAMA)
    return texts.select("id", F.posexplode("rounds").alias("i", "r")).select(
        "id", F.col("i").cast("bigint").alias("i"), "r.instruction", "r.reply"
    )


@query(
    "tokenize",
    "WITH " + sql.tokens(LLAMA) + " SELECT id, n, array_to_string(ids, ' ') AS ids FROM tokens",
)
def tokenize(spark, sf_dir):
    texts = feat.chat_texts(inputs.trainable(spark, sf_dir), LLAMA)
    return feat.tokenize(texts, TOKENIZER, MAX_LEN).select(
        "id", F.size("input_ids").cast("bigint").alias("n"), _text("input_ids").alias("ids")
    )


@query(
    "tokenize_documents",
    f"""SELECT doc_id, len(ids) AS n, md5(array_to_string(ids, ' ')) AS digest
    FROM (SELECT doc_id, list_transform({sql.words('text')}, lambda w: {sql.token_id('w')}) AS ids
          FROM documents)""",
)
def tokenize_documents(spark, sf_dir):
    """Whole documents, without a cap on their length."""
    docs = feat.tokenize(table(spark, sf_dir, "documents"), TOKENIZER, max_len=None)
    return docs.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n"),
        F.md5(_text("input_ids")).alias("digest"),
    )


def _masked(template, policy, max_len=MAX_LEN):
    def run(spark, sf_dir):
        conv = inputs.trainable(spark, sf_dir)
        rows = feat.featurize(conv, template, TOKENIZER, max_len, policy)
        return rows.select("id", _text("loss_mask", "").alias("mask"))

    return run


for _name, _template in (("loss_mask", LLAMA), ("loss_mask_gemma", GEMMA)):
    query(
        _name,
        "WITH " + sql.masks(_template)
        + " SELECT id, string_agg(bit::VARCHAR, '' ORDER BY t) AS mask FROM masks GROUP BY id",
    )(_masked(_template, "reference"))
query(
    "loss_mask_uncapped",
    "WITH " + sql.masks(LLAMA, cap="")
    + " SELECT id, string_agg(bit::VARCHAR, '' ORDER BY t) AS mask FROM masks GROUP BY id",
)(_masked(LLAMA, "reference", None))
for _name, _template in (("loss_mask_content", LLAMA), ("loss_mask_content_gemma", GEMMA)):
    query(
        _name,
        "WITH " + sql.content_masks(_template)
        + " SELECT id, string_agg(bit::VARCHAR, '' ORDER BY t) AS mask FROM content GROUP BY id",
    )(_masked(_template, "content"))


@query(
    "attention_mask",
    "WITH " + sql.tokens(LLAMA) + " SELECT id, repeat('1', n) AS mask FROM tokens",
)
def attention_mask(spark, sf_dir):
    texts = feat.chat_texts(inputs.trainable(spark, sf_dir), LLAMA)
    masked = feat.attention_mask(feat.tokenize(texts, TOKENIZER, MAX_LEN))
    return masked.select("id", _text("attention_mask", "").alias("mask"))


FEATURES_SQL = "WITH " + sql.masks(LLAMA) + """,
features AS (
  SELECT id, conv_id, string_agg(token_id::VARCHAR, ' ' ORDER BY t) AS ids,
         string_agg(bit::VARCHAR, '' ORDER BY t) AS mask, count(*) AS n
  FROM masks GROUP BY id, conv_id)"""


@query("project_features", FEATURES_SQL + " SELECT ids, mask, repeat('1', n) AS attention FROM features")
def project_features(spark, sf_dir):
    rows = feat.project_features(inputs.llama_features(spark, sf_dir))
    return rows.select(
        _text("input_ids").alias("ids"), _text("loss_mask", "").alias("mask"),
        _text("attention_mask", "").alias("attention"),
    )


@query(
    "shift_tokens",
    "WITH " + sql.tokens(LLAMA) + """
    SELECT id, array_to_string(list_concat(ids[2:], [0]), ' ') AS next_ids,
           array_to_string(list_concat([0], ids[:len(ids) - 1]), ' ') AS previous_ids
    FROM tokens""",
)
def shift_tokens(spark, sf_dir):
    rows = inputs.llama_features(spark, sf_dir).select(
        "id", F.col("input_ids").alias("next_ids"), F.col("input_ids").alias("previous_ids")
    )
    shifted = feat.shift_tokens(feat.shift_tokens(rows, "next_ids", False), "previous_ids", True)
    return shifted.select(
        "id", _text("next_ids").alias("next_ids"), _text("previous_ids").alias("previous_ids")
    )


def shards_sql(world: int, epoch: int, source: str, key: str = "id") -> str:
    return f""",
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{42 + epoch}:' || {key})) - 1 AS r,
         count(*) OVER () AS total FROM {source}),
dealt AS (
  SELECT * EXCLUDE (r, total), unnest(range(r, CAST(ceil(total / {world}.0) * {world} AS BIGINT), total))
         AS position, total FROM ranked),
sharded AS (
  SELECT * EXCLUDE (total), position % {world} AS worker, position // {world} AS pos_in_worker,
         position >= total AS is_pad FROM dealt)"""


@query(
    "pad_batch",
    FEATURES_SQL + shards_sql(8, 1, "features") + """,
    wide AS (SELECT *, pos_in_worker // 6 AS microbatch,
             max(n) OVER (PARTITION BY worker, pos_in_worker // 6) AS width FROM sharded)
    SELECT id, worker, microbatch, is_pad, ids || repeat(' 0', width - n) AS ids,
           mask || repeat('0', width - n) AS mask,
           repeat('1', n) || repeat('0', width - n) AS attention
    FROM wide""",
)
def pad_batch(spark, sf_dir):
    rows = inputs.llama_features(spark, sf_dir).drop("conv_id")
    dealt = sampling.shard_for_ranks(rows, world=8, epoch=1, tie=[])
    padded = feat.pad_batch(sampling.assign_microbatches(dealt, 6), "worker", "microbatch")
    return padded.select(
        "id", "worker", "microbatch", "is_pad", _text("input_ids").alias("ids"),
        _text("loss_mask", "").alias("mask"), _text("attention_mask", "").alias("attention"),
    )


# --- vocabulary -------------------------------------------------------------------------


def _frequency(spark: SparkSession, sf_dir: str, seq: str | None = None) -> DataFrame:
    return vocabulary.token_frequency(inputs.llama_features(spark, sf_dir), seq)


def _maps(maps: DataFrame, *more: str) -> DataFrame:
    longs = [F.col(c).cast("bigint").alias(c) for c in ("draft_id", "token_id", "offset")]
    return maps.select(*longs, *more)


def _vocab(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    features = inputs.llama_features(spark, sf_dir) if features is None else features
    top = vocabulary.top_n_tokens(vocabulary.token_frequency(features), DRAFT_SIZE, "token_id")
    return _maps(vocabulary.draft_to_target(top))


@query("token_frequency", "WITH " + sql.FREQUENCY + " SELECT token_id, freq FROM frequency")
def token_frequency(spark, sf_dir):
    return _frequency(spark, sf_dir)


DOC_FREQUENCY_SQL = f"""WITH doc_words AS (SELECT unnest({sql.words('text')}) AS w FROM documents),
frequency AS (SELECT {sql.token_id('w')} AS token_id, count(*) AS freq FROM doc_words GROUP BY 1)"""


@query("token_frequency_documents", DOC_FREQUENCY_SQL + " SELECT token_id, freq FROM frequency")
def token_frequency_documents(spark, sf_dir):
    return vocabulary.text_token_frequency(table(spark, sf_dir, "documents"), TOKENIZER)


@query("merge_token_counts", DOC_FREQUENCY_SQL + " SELECT token_id, freq FROM frequency")
def merge_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    english = F.col("lang") == "en"
    parts = [docs.filter(english), docs.filter(~english | F.col("lang").isNull())]
    return vocabulary.merge_token_counts(
        *[vocabulary.text_token_frequency(p, TOKENIZER) for p in parts]
    )


@query(
    "top_n_tokens",
    "WITH " + sql.top(DRAFT_SIZE, "first_seen")
    + " SELECT token_id, freq, first_row, first_pos::BIGINT AS first_pos FROM top",
)
def top_n_tokens(spark, sf_dir):
    top = vocabulary.top_n_tokens(_frequency(spark, sf_dir, "conv_id"), DRAFT_SIZE)
    return top.select(
        "token_id", "freq", F.col("first_seen.seq").alias("first_row"),
        F.col("first_seen.pos").cast("bigint").alias("first_pos"),
    )


@query(
    "top_n_tokens_by_id",
    DOC_FREQUENCY_SQL + " SELECT token_id, freq FROM frequency ORDER BY freq DESC, token_id LIMIT 1000",
)
def top_n_tokens_by_id(spark, sf_dir):
    freq = token_frequency_documents(spark, sf_dir)
    return vocabulary.top_n_tokens(freq, 1000, "token_id")


@query(
    "coverage_ratio",
    "WITH " + sql.top(DRAFT_SIZE) + """
    SELECT (SELECT sum(freq) FROM top)::BIGINT AS top_freq,
           (SELECT sum(freq) FROM frequency)::BIGINT AS total_freq,
           round((SELECT sum(freq) FROM top) / (SELECT sum(freq) FROM frequency)::DOUBLE + 1e-9::DOUBLE, 6) AS coverage""",
)
def coverage_ratio(spark, sf_dir):
    ratio = vocabulary.coverage_ratio(_frequency(spark, sf_dir), DRAFT_SIZE)
    return ratio.withColumn("coverage", _rounded("coverage"))


@query(
    "draft_to_target",
    "WITH " + sql.top(DRAFT_SIZE) + """
    SELECT draft_id, token_id, token_id - draft_id AS "offset" FROM vocab""",
)
def draft_to_target(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query(
    "target_in_draft",
    "WITH " + sql.top(DRAFT_SIZE) + """
    SELECT r.range AS token_id, r.range IN (SELECT token_id FROM vocab) AS in_draft
    FROM range(4096) r""",
)
def target_in_draft(spark, sf_dir):
    return vocabulary.target_in_draft(
        spark, _vocab(spark, sf_dir), TOKENIZER.vocab_size, DRAFT_SIZE
    )


@query(
    "build_draft_vocab",
    "WITH " + sql.top(DRAFT_SIZE) + """
    SELECT draft_id, token_id, token_id - draft_id AS "offset", freq FROM vocab""",
)
def build_draft_vocab(spark, sf_dir):
    built = jobs.build_draft_vocab(
        inputs.trainable(spark, sf_dir), LLAMA, TOKENIZER, DRAFT_SIZE, MAX_LEN, ties="token_id"
    )
    return _maps(built.maps, "freq")


TRUTH_SQL = "WITH " + sql.top(DRAFT_SIZE) + sql.TRUTH


@query(
    "mask_by_draft_vocab",
    TRUTH_SQL + """
    SELECT seq, pos, target_id, mask,
           CASE WHEN target_id IN (SELECT token_id FROM vocab) THEN mask ELSE 0 END AS position_mask
    FROM truth""",
)
def mask_by_draft_vocab(spark, sf_dir):
    features = inputs.stored_features(spark, sf_dir)
    vocab = _vocab(spark, sf_dir, features)
    masked = vocabulary.mask_by_draft_vocab(inputs.truth(features), vocab, DRAFT_SIZE)
    return masked.select(
        "seq", F.col("pos").cast("bigint").alias("pos"), "target_id", "mask", "position_mask"
    )


@query(
    "decode_draft_ids",
    TRUTH_SQL + """
    SELECT seq, pos, draft_id, token_id FROM truth JOIN vocab ON token_id = target_id""",
)
def decode_draft_ids(spark, sf_dir):
    features = inputs.stored_features(spark, sf_dir)
    vocab, truth = _vocab(spark, sf_dir, features), inputs.truth(features)
    encoded = vocabulary.encode_token_ids(
        truth.withColumnRenamed("target_id", "token_id"), vocab, DRAFT_SIZE
    ).drop("token_id")
    decoded = vocabulary.decode_draft_ids(encoded, vocab, DRAFT_SIZE)
    return decoded.select("seq", F.col("pos").cast("bigint").alias("pos"), "draft_id", "token_id")


# --- metrics ----------------------------------------------------------------------------


@query(
    "epoch_metrics",
    f"""WITH {sql.STEPS},
    per_worker AS (SELECT split, epoch, position, metric, worker, avg(value) AS value FROM steps
                   GROUP BY ALL)
    SELECT split, epoch, position, metric, round(avg(value) + 1e-9::DOUBLE, 6) AS value FROM per_worker
    GROUP BY ALL""",
)
def epoch_metrics(spark, sf_dir):
    means = metrics.epoch_metrics(inputs.steps(spark, sf_dir))
    return means.withColumn("value", _rounded("value"))


@query("parse_train_log", f"WITH {sql.STEPS} SELECT split, epoch, metric, value FROM steps")
def parse_train_log(spark, sf_dir):
    return metrics.parse_train_log(inputs.log_lines(spark, sf_dir))


LOG_MEANS_SQL = f"""WITH {sql.STEPS},
means AS (SELECT split, epoch, metric, round(avg(value) + 1e-9::DOUBLE, 6) AS value FROM steps GROUP BY ALL)"""


@query("log_epoch_means", LOG_MEANS_SQL + " SELECT * FROM means")
def log_epoch_means(spark, sf_dir):
    rows = metrics.parse_train_log(inputs.log_lines(spark, sf_dir), require_rows=False)
    return metrics.log_epoch_means(rows).withColumn("value", _rounded("value"))


@query(
    "pivot_metrics",
    LOG_MEANS_SQL + """
    SELECT split, epoch, max(value) FILTER (metric = 'Acc') AS "Acc",
           max(value) FILTER (metric = 'pLoss') AS "pLoss"
    FROM means GROUP BY split, epoch""",
)
def pivot_metrics(spark, sf_dir):
    return metrics.pivot_metrics(log_epoch_means(spark, sf_dir))


@query(
    "training_report",
    LOG_MEANS_SQL + """
    SELECT split, epoch, max(value) FILTER (metric = 'Acc') AS "Acc",
           max(value) FILTER (metric = 'pLoss') AS "pLoss"
    FROM means GROUP BY split, epoch""",
)
def training_report(spark, sf_dir):
    path = fresh_path(spark, "log")
    inputs.log_lines(spark, sf_dir).write.text(path)
    report = jobs.training_report(spark, path)
    return report.withColumns({m: _rounded(m) for m in metrics.METRICS})


@query(
    "weighted_position_loss",
    """SELECT event_id // 7 AS step, round(sum(0.8::DOUBLE ** (event_id % 7) * value) + 1e-9::DOUBLE, 6) AS ploss
    FROM events GROUP BY 1""",
)
def weighted_position_loss(spark, sf_dir):
    losses = inputs.steps(spark, sf_dir).select(
        F.floor(F.col("event_id") / 7).alias("step"), "position", F.col("value").alias("loss")
    )
    return metrics.weighted_position_loss(losses, "step").withColumn("ploss", _rounded("ploss"))


@query(
    "acceptance_accuracy",
    TRUTH_SQL + """,
    guesses AS (
      SELECT seq, pos, k.range AS k,
             CASE WHEN substr(md5(seq || ':' || pos || ':' || k.range), 1, 1) BETWEEN '0' AND '9'
                  THEN target_id ELSE (target_id + 1) % 4096 END AS draft_id
      FROM truth, range(7) k),
    met AS (
      SELECT g.k, t.mask, CASE WHEN g.draft_id = t.target_id
                                AND t.target_id IN (SELECT token_id FROM vocab)
                               THEN t.mask ELSE 0 END AS hit
      FROM guesses g LEFT JOIN truth t ON t.seq = g.seq AND t.pos = g.pos + g.k)
    SELECT k, coalesce(sum(hit), 0)::BIGINT AS hits, coalesce(sum(mask), 0)::BIGINT AS positions,
           round(coalesce(sum(hit), 0) / (coalesce(sum(mask), 0) + 1e-6::DOUBLE) + 1e-9::DOUBLE, 6) AS accuracy
    FROM met GROUP BY k""",
)
def acceptance_accuracy(spark, sf_dir):
    features = inputs.stored_features(spark, sf_dir)
    vocab = _vocab(spark, sf_dir, features)
    rows = vocabulary.kept_positions(
        inputs.drafts(features), vocab, TOKENIZER.vocab_size, DRAFT_SIZE
    )
    result = metrics.acceptance_accuracy(rows)
    return result.select(
        F.col("k").cast("bigint").alias("k"), "hits", "positions",
        _rounded("accuracy").alias("accuracy"),
    )


@query(
    "trimmed_mean_latency",
    f"WITH {sql.trimmed('engine')} SELECT engine, round(latency + 1e-9::DOUBLE, 6) AS latency FROM trimmed",
)
def trimmed_mean_latency(spark, sf_dir):
    means = metrics.trimmed_mean_latency(inputs.latency(spark, sf_dir), "engine")
    return means.withColumn("latency", _rounded("latency"))


@query(
    "throughput",
    r"""SELECT conv_id, turn, words, round((words + 256) / seconds + 1e-9::DOUBLE, 6) AS tokens_per_second FROM (
      SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words,
             value AS seconds
      FROM conversations JOIN events ON event_id = conv_id * 8 + turn)""",
)
def throughput(spark, sf_dir):
    """Every turn as a prompt, timed by the event of its number."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    seconds = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("latency"))
    timed = turns.join(seconds, F.col("event_id") == F.col("conv_id") * 8 + F.col("turn"))
    rates = metrics.throughput(timed, prompt="text")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")
    return rates.select(
        "conv_id", "turn", words.alias("words"), _rounded("tokens_per_second").alias("tokens_per_second")
    )


@query(
    "speedup_report",
    f"""WITH {sql.trimmed('engine', 'run')}
    SELECT c.engine, c.run, round(b.latency / c.latency + 1e-9::DOUBLE, 6) AS speedup
    FROM trimmed c JOIN trimmed b ON b.run = c.run AND b.engine = 'view'
    WHERE c.engine <> 'view'""",
)
def speedup_report(spark, sf_dir):
    means = metrics.trimmed_mean_latency(inputs.latency(spark, sf_dir), "engine", "run")
    base = means.filter("engine = 'view'").drop("engine")
    report = metrics.speedup_report(base, means.filter("engine <> 'view'"), "run")
    return report.select("engine", "run", _rounded("speedup").alias("speedup"))


# --- order, sampling, sharding ----------------------------------------------------------


@query(
    "seeded_shuffle",
    """SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS rank
    FROM documents""",
)
def seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.seeded_shuffle(docs, "doc_id", tie=["doc_id"])


@query(
    "exact_split",
    """SELECT doc_id, lang, text, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1
         < floor(count(*) OVER () * 0.95::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM documents""",
)
def exact_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return sampling.exact_split(docs, "doc_id")


@query(
    "bernoulli_sample",
    f"""SELECT doc_id, lang, text FROM documents
    WHERE substr(md5('42:' || doc_id), 1, 8) < '{hex_threshold(0.1)}'""",
)
def bernoulli_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return sampling.bernoulli_sample(docs, "doc_id", 0.1)


@query(
    "order_by_id_suffix",
    """SELECT CASE WHEN conv_id % 7 = 0 THEN 'plain' || conv_id ELSE 'sharegpt_' || conv_id END AS id,
           turn, text, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE conv_id END AS suffix
    FROM conversations""",
)
def order_by_id_suffix(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    prefix = F.when(F.col("conv_id") % 7 == 0, "plain").otherwise("sharegpt_")
    named = F.concat(prefix, F.col("conv_id").cast("string")).alias("id")
    return sampling.order_by_id_suffix(turns.select(named, "turn", "text"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


DOC_IDS = "WITH ids AS (SELECT doc_id, text FROM documents)"


@query(
    "shard_for_ranks",
    DOC_IDS + shards_sql(7, 3, "ids", "doc_id") + " SELECT * FROM sharded",
)
def shard_for_ranks(spark, sf_dir):
    return sampling.shard_for_ranks(_ids(spark, sf_dir), world=7, epoch=3, key="doc_id")


@query(
    "shard_for_ranks_in_order",
    DOC_IDS + shards_sql(7, 0, "ids", "doc_id").replace("md5('42:' || doc_id)", "doc_id")
    + " SELECT * FROM sharded",
)
def shard_for_ranks_in_order(spark, sf_dir):
    return sampling.shard_for_ranks(_ids(spark, sf_dir), 7, shuffle=False, order="doc_id")


@query(
    "assign_microbatches",
    DOC_IDS + shards_sql(6, 1, "ids", "doc_id") + """
    SELECT worker, pos_in_worker // 6 AS microbatch, count(*) AS records, min(doc_id) AS first_doc,
           sum(length(text))::BIGINT AS chars
    FROM sharded GROUP BY 1, 2""",
)
def assign_microbatches(spark, sf_dir):
    dealt = sampling.shard_for_ranks(_ids(spark, sf_dir), world=6, epoch=1, key="doc_id")
    return sampling.assign_microbatches(dealt, 6).groupBy("worker", "microbatch").agg(
        F.count(F.lit(1)).alias("records"), F.min("doc_id").alias("first_doc"),
        F.sum(F.length("text")).alias("chars"),
    )


@query(
    "union_all_files",
    """SELECT doc_id, lang, text, NULL::INTEGER AS quality FROM documents
    UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels""",
)
def union_all_files(spark, sf_dir):
    return src.union_all_files(
        [
            table(spark, sf_dir, "documents").select("doc_id", "lang", "text"),
            table(spark, sf_dir, "labels").select("doc_id", "quality"),
        ]
    )


# --- generation -------------------------------------------------------------------------


def md5_reply(prompt: str) -> str:
    """Stands in for a text service: the digest of the prompt."""
    return hashlib.md5(prompt.encode()).hexdigest()


NO_WAIT = regenerate.RetryPolicy(min_interval=0, first_wait=0, wait_step=0, max_attempts=5)

REPLAY_SQL = f"""WITH RECURSIVE {sql.DIALOGUE},
replay AS (
  SELECT id, -1::BIGINT AS ord, NULL::VARCHAR AS speaker, NULL::VARCHAR AS value, '' AS context
  FROM (SELECT DISTINCT id FROM dialogue)
  UNION ALL
  SELECT r.id, d.ord, d.speaker,
         CASE d.speaker WHEN 'human' THEN d.value ELSE md5(r.context || 'Assistant:') END,
         r.context || CASE d.speaker WHEN 'human' THEN 'Human: ' || d.value
                      ELSE 'Assistant: ' || md5(r.context || 'Assistant:') END
         || chr(10) || chr(10)
  FROM replay r JOIN dialogue d ON d.id = r.id AND d.ord = r.ord + 1)"""


@query(
    "regenerate_replies",
    REPLAY_SQL + " SELECT id, ord AS pos, speaker, value FROM replay WHERE ord >= 0",
)
def regenerate_replies(spark, sf_dir):
    conv = _indexed(spark, sf_dir)
    return _flat(regenerate.regenerate_replies(conv, md5_reply, NO_WAIT).select("id", "conversations"))


@query(
    "regenerate_corpus",
    REPLAY_SQL + " SELECT id, ord AS pos, speaker, value FROM replay WHERE ord >= 0",
)
def regenerate_corpus(spark, sf_dir):
    """The whole job: replay in commits, continue over what is there, merge, read back."""
    saved, merged = fresh_path(spark, "saved"), fresh_path(spark, "merged")
    conv = _indexed(spark, sf_dir)
    total = conv.count()
    half = total // 2
    for end in (half, total):
        jobs.regenerate_corpus(
            spark, conv, saved, md5_reply, batch_save=max(1, total // 20), start_index=0,
            end_index=end, policy=NO_WAIT,
        )
    jobs.merge_corpus(spark, saved, merged)
    return _flat(src.scan_conversations_jsonl(spark, merged))


def _long_turns(batch: pa.RecordBatch) -> pa.RecordBatch:
    length = pc.utf8_length(batch.column("text"))
    keep = pc.greater_equal(length, 100)
    rows = pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pc.cast(length, pa.int64())], names=["doc_id", "chars"]
    )
    return rows.filter(keep)


@query(
    "map_batched",
    "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 100",
)
def map_batched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return regenerate.map_batched(docs, _long_turns, "doc_id bigint, chars bigint", arrow=True)


# --- streams ----------------------------------------------------------------------------


@query("stream_clean", CLEAN_SQL + " SELECT id, ord AS pos, speaker, value FROM kept")
def stream_clean(spark, sf_dir):
    arriving = fresh_path(spark, "arriving")
    cleaned = fresh_path(spark, "cleaned")
    progress = fresh_path(spark, "progress")
    blanked = tt.collect_turns(inputs.blanked(spark, sf_dir))
    for half in (0, 1):  # files that arrive between two runs
        part = blanked.filter(F.substring_index("id", "_", -1).cast("bigint") % 2 == half)
        sinks.write_jsonl(part, arriving, mode="append")
        streams.stream_clean(spark, arriving, cleaned, progress).awaitTermination()
    return _flat(spark.read.schema(CONVERSATION).json(cleaned))


@query("stream_token_frequency", DOC_FREQUENCY_SQL + " SELECT token_id, freq FROM frequency")
def stream_token_frequency(spark, sf_dir):
    out, progress = fresh_path(spark, "counts"), fresh_path(spark, "progress")
    streams.stream_token_frequency(
        spark, f"{sf_dir}/documents*.parquet", out, progress, TOKENIZER
    ).awaitTermination()
    return streams.latest_frequency(spark, out)


@query(
    "stream_supervised_frequency",
    "WITH " + sql.FREQUENCY + " SELECT token_id, freq FROM frequency",
)
def stream_supervised_frequency(spark, sf_dir):
    """Conversations in files that arrive in two runs, the later ones first."""
    arriving, out, progress = (fresh_path(spark, n) for n in ("arriving", "counts", "progress"))
    conv = inputs.trainable(spark, sf_dir)
    middle = conv.agg(F.percentile_approx("conv_id", 0.5)).first()[0] or 0
    for part in (F.col("conv_id") > middle, F.col("conv_id") <= middle):
        sinks.write_jsonl(conv.filter(part), arriving, mode="append")
        streams.stream_supervised_frequency(
            spark, arriving, out, progress, LLAMA, TOKENIZER, max_len=MAX_LEN
        ).awaitTermination()
    return streams.latest_frequency(spark, out)


@query("stream_conversations", CLEAN_SQL + " SELECT id, ord AS pos, speaker, value FROM kept")
def stream_conversations(spark, sf_dir):
    """Turns of all conversations, a place a second, in four files that arrive in two runs.

    Conversations stay open from file to file; a last turn far in the future closes them all.
    """
    arriving, out, progress = (fresh_path(spark, n) for n in ("arriving", "closed", "progress"))
    at = F.timestamp_seconds(F.col("pos") + 10**9)
    turns = inputs.blanked(spark, sf_dir).select("id", "pos", "from", "value", at.alias("ts"))
    end = turns.agg(F.max("pos")).first()[0] or 0
    later = spark.range(1).select(
        F.lit("end").alias("id"), F.lit(0).cast("bigint").alias("pos"), F.lit("system").alias("from"),
        F.lit("").alias("value"), F.timestamp_seconds(F.lit(end + 10**9 + 10**6)).alias("ts"),
    )
    for step in range(2):
        half = turns.filter(F.floor(F.col("pos") * 2 / (end + 1)) == step)
        sinks.write_jsonl(half.repartitionByRange(2, "pos"), arriving, mode="append")
        if step:
            sinks.write_jsonl(later, arriving, mode="append")
        closing.stream_conversations(
            spark, arriving, out, progress, end + 10, f"{end + 10} seconds"
        ).awaitTermination()
    return _flat(spark.read.schema(CONVERSATION).json(out))
