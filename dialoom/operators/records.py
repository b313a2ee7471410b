"""Operators over nested records: ``id``, ``conversations`` and any further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions import turns as t
from dialoom.functions.masks import running_sums
from dialoom.functions.text import reply_prompt, transcript_line
from dialoom.schema import REPLY


def _on_turns(df: DataFrame, change) -> DataFrame:
    return df.withColumn("conversations", change(F.col("conversations")))


def drop_trailing_human(df: DataFrame) -> DataFrame:
    return _on_turns(df, t.drop_trailing_human)


def drop_trailing_empty_reply(df: DataFrame) -> DataFrame:
    return _on_turns(df, t.drop_trailing_empty_reply)


def clean_conversations(df: DataFrame) -> DataFrame:
    """Trailing human turn, then trailing empty exchange; emptied records stay."""
    return drop_trailing_empty_reply(drop_trailing_human(df))


def clean_variant(df: DataFrame, record: str = "record") -> DataFrame:
    """``clean_conversations`` inside whole records in a VARIANT column, in one pass, without a schema.

    All other keys, and all keys of the turns that stay, keep their values, whatever their types and
    however they differ from record to record (as a VARIANT holds them: numbers lose trailing
    zeros, keys come in order of their names). A body that is no text is empty if it is ``null``, ``0``,
    ``false`` or an empty list or object. Records without a list of conversations stay as they are.
    """
    whole = F.try_variant_get(record, "$", "map<string,variant>")
    turns = F.try_variant_get(whole["conversations"], "$", "array<variant>")

    def plain(turn: Column) -> Column:
        body = F.try_variant_get(turn, "$.value", "variant")
        text = F.try_variant_get(body, "$", "string")
        other = F.to_json(body)
        empty = other.isin("null", "0", "0.0", "false", "[]", "{}")
        said = F.when(F.schema_of_variant(body) == "STRING", text).when(~empty, other)
        speaker = F.try_variant_get(turn, "$.from", "string")
        return F.struct(speaker.alias("from"), said.alias("value"))

    outline = F.transform(turns, plain)
    kept = F.size(t.drop_trailing_empty_reply(t.drop_trailing_human(outline)))
    cut = F.to_variant_object(F.slice(turns, F.lit(1), kept))
    shorter = turns.isNotNull() & (kept < F.size(turns))
    rebuilt = F.transform_values(whole, lambda k, v: F.when(k == "conversations", cut).otherwise(v))
    return df.withColumn(record, F.when(shorter, F.to_variant_object(rebuilt)).otherwise(F.col(record)))


def skip_empty(df: DataFrame) -> DataFrame:
    return df.filter(F.size("conversations") > 0)


def drop_leading_non_human(df: DataFrame) -> DataFrame:
    return _on_turns(df, t.drop_leading_non_human)


def keep_dialogue_roles(df: DataFrame) -> DataFrame:
    return _on_turns(df, lambda c: t.keep_dialogue_roles(t.turns_or_none(c)))


def check_alternation(df: DataFrame, on_error: str = "fail") -> DataFrame:
    """Human and reply turns must alternate, starting with a human.

    ``fail`` aborts the job, ``drop`` removes the record, ``quarantine`` adds the boolean
    ``alternates`` and keeps everything.
    """
    ok = t.alternates(F.col("conversations"))
    if on_error == "fail":
        broken = F.raise_error(F.concat(F.lit("turns out of order in "), F.col("id")))
        return df.filter(F.when(ok, True).otherwise(broken.cast("boolean")))
    if on_error == "drop":
        return df.filter(ok)
    if on_error == "quarantine":
        return df.withColumn("alternates", ok)
    raise ValueError(f"unknown on_error: {on_error}")


def to_messages(df: DataFrame, reply_role: str, system: str | None = None) -> DataFrame:
    """Replace ``conversations`` by role/content ``messages``, after an optional system one."""
    messages = t.map_roles(F.col("conversations"), reply_role)
    if system is not None:
        messages = t.inject_system(messages, system)
    return df.withColumn("messages", messages).drop("conversations")


def trainable_turns(df: DataFrame, on_error: str = "fail") -> DataFrame:
    """Records that can be trained on, from a human turn on and in strict alternation.

    Same as skip_empty, drop_leading_non_human and check_alternation, with a single filter.
    Records without any turn left are skipped.
    """
    led = df.withColumn("conversations", t.drop_leading_non_human(F.col("conversations")))
    kept = skip_empty(led)
    if on_error == "fail":
        broken = F.raise_error(F.concat(F.lit("turns out of order in "), F.col("id")))
        # As a filter, it holds whatever columns are used later.
        return kept.filter(
            F.when(t.alternates(F.col("conversations")), True).otherwise(broken.cast("boolean"))
        )
    return check_alternation(kept, on_error)


def build_prompts(df: DataFrame) -> DataFrame:
    """One row per stored reply with the prompt that leads up to it: ``id, pos, prompt``."""
    exploded = df.select(
        "id", "conversations", F.posexplode("conversations").alias("pos", "turn")
    ).filter(F.col("turn.from") == REPLY)
    earlier = F.slice(F.col("conversations"), F.lit(1), F.col("pos"))
    return exploded.select("id", "pos", reply_prompt(earlier).alias("prompt"))


def transcripts(df: DataFrame) -> DataFrame:
    """``id, transcript, replies`` with ``replies: array<struct<pos, length>>``.

    The prompt of the reply at ``pos`` is the first ``length`` characters of the transcript and
    ``Assistant:`` (``prompt_at``). What ``build_prompts`` repeats for every reply is held once here,
    so a record grows with its length; whoever calls the generator expands one prompt at a time.
    """
    pieces = F.transform("conversations", lambda turn: transcript_line(turn["from"], turn["value"]))
    ends = F.slice(running_sums(0, F.transform(pieces, F.length)), 1, F.size(pieces))
    at = F.zip_with(
        F.transform("conversations", lambda turn, i: F.struct(turn["from"].alias("from"), i.alias("pos"))),
        ends,
        lambda turn, length: F.struct(
            turn["from"].alias("from"), turn["pos"].alias("pos"), length.alias("length")
        ),
    )
    replies = F.transform(
        F.filter(at, lambda r: r["from"] == REPLY),
        lambda r: F.struct(r["pos"].alias("pos"), r["length"].alias("length")),
    )
    return df.select("id", F.array_join(pieces, "").alias("transcript"), replies.alias("replies"))


def prompt_at(text: Column, length: Column) -> Column:
    """The prompt that ends after ``length`` characters of a transcript."""
    return F.concat(F.substring(text, F.lit(1), length), F.lit("Assistant:"))
