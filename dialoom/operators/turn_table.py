"""Turn tables: one row per turn, columns ``id, pos, from, value``.

A conversation may hold any number of turns here, so no step gathers one in a single task.
Turns are numbered in chunks, which moves each row once. What to keep follows from positions,
speakers and an emptiness flag: conversation-level facts are map-side aggregates of a few numbers
that reach the turns by chunk. ``numbered`` carries the text along; an *outline* goes without.
Rows with a null id belong to one conversation without a name; all joins keep them. Turns that
share a place (``pos``) in a conversation are numbered one by one, so no row multiplies and a
step that removes the last turn removes one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.turns import canonical_speaker, chat_role
from dialoom.schema import HUMAN, REPLY

# Positions that are numbered together. Ranks do not depend on it.
CHUNK = 4096


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the left side's keys are kept."""
    right = right.select(*[F.col(c).alias(f"_right_{c}" if c in on else c) for c in right.columns])
    same = reduce(Column.__and__, [left[c].eqNullSafe(right[f"_right_{c}"]) for c in on])
    return left.join(right, same, how).drop(*[f"_right_{c}" for c in on])


def explode_turns(conv: DataFrame) -> DataFrame:
    """Nested conversations to one row per turn, with its place in the record."""
    other = [c for c in conv.columns if c != "conversations"]
    return conv.select("*", F.posexplode_outer("conversations").alias("_pos", "_turn")).select(
        *other,
        F.col("_pos").cast("bigint").alias("pos"),
        F.col("_turn.from").alias("from"),
        F.col("_turn.value").alias("value"),
    )


def _chunk(pos: Column) -> Column:
    return F.floor(pos / CHUNK)


def number_turns(turns: DataFrame, alias: str = "ord") -> DataFrame:
    """Add the 0-based rank of each turn in its conversation; speakers order turns of one place.

    Ranks are counted inside chunks of positions; later chunks of long conversations get
    the number of turns before them. Rows move once, by ``(id, chunk)``.
    """
    chunked = turns.withColumn("_chunk", _chunk(F.col("pos")))
    sizes = chunked.groupBy("id", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sizes.withColumn("_offset", F.sum("_size").over(before))
        .filter(F.col("_offset") > 0)
        .drop("_size")
    )
    ties = [c for c in ("from", "empty") if c in turns.columns]
    in_chunk = Window.partitionBy("id", "_chunk").orderBy("pos", *ties)
    kept = [c for c in turns.columns if c != alias]
    rank = F.coalesce("_offset", F.lit(0)) + F.row_number().over(in_chunk) - 1
    joined = join_null_safe(chunked, offsets, ["id", "_chunk"], "left")
    return joined.select(*kept, rank.alias(alias))


def numbered(turns: DataFrame) -> DataFrame:
    """All columns of a turn table with ``empty`` and ``ord``: what the steps below take."""
    return number_turns(turns.withColumn("empty", F.coalesce("value", F.lit("")) == ""))


def outline(turns: DataFrame) -> DataFrame:
    """``id, pos, from, empty, ord`` of every turn, without the text."""
    empty = (F.coalesce("value", F.lit("")) == "").alias("empty")
    return number_turns(turns.select("id", "pos", "from", empty))


def pick(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The turns of an outline with their text, joined by ``(id, pos)``, which must be unique.

    Where ids or places may repeat, take ``numbered`` through the steps instead.
    """
    other = [c for c in turns.columns if c not in ("id", "pos", "from", "ord")]
    return join_null_safe(
        turns.select("id", "pos", *other), kept.select("id", "pos", "ord", "from"), ["id", "pos"]
    )


def keep_dialogue_roles(turns: DataFrame) -> DataFrame:
    """Only human and reply turns, under their canonical names; positions keep their gaps."""
    return turns.withColumn("from", canonical_speaker(F.col("from"))).filter(
        F.col("from").isNotNull()
    )


def conversation_tails(numbered: DataFrame) -> DataFrame:
    """Last three turns of every conversation in an outline, as ``id, tail``.

    Consecutive ranks differ modulo 3, so three plain maxima find them. The speaker and the
    emptiness of the value ride in the low bits of the rank.
    """
    code = F.when(F.col("from") == HUMAN, 1).when(F.col("from") == REPLY, 2).otherwise(0)
    empty = F.col("empty").cast("int")
    packed = F.col("ord") * 8 + code * 2 + empty

    def last_with(r: int, what: Column) -> Column:
        return F.max(F.when(F.col("ord") % 3 == r, what))

    maxima = numbered.groupBy("id").agg(
        *[last_with(r, packed).alias(f"_turn{r}") for r in range(3)],
        *[last_with(r, F.col("pos")).alias(f"_pos{r}") for r in range(3)],
    )

    def unpacked(r: int) -> Column:
        turn = F.col(f"_turn{r}")
        return F.when(
            turn.isNotNull(),
            F.struct(
                F.floor(turn / 8).alias("ord"),
                F.col(f"_pos{r}").alias("pos"),
                (F.floor(turn / 2) % 4).alias("code"),
                (turn % 2).alias("empty"),
            ),
        )

    tail = F.sort_array(F.array_compact(F.array(*[unpacked(r) for r in range(3)])), asc=False)
    return maxima.select("id", tail.alias("tail"))


def _cut_tail(numbered: DataFrame, cut_at: Column) -> DataFrame:
    """Drop every turn from the one at ``cut_at`` on (an expression over ``tail``).

    Only chunks that lose a turn are joined, on the key the turns are already spread by.
    """
    cuts = conversation_tails(numbered).select("id", "tail", cut_at["ord"].alias("_cut"))
    lost = F.filter("tail", lambda t: t["ord"] >= F.col("_cut"))
    touched = cuts.filter(F.col("_cut").isNotNull()).select(
        "id", "_cut", F.explode(F.array_distinct(F.transform(lost, lambda t: _chunk(t["pos"])))).alias("_chunk")
    )
    chunked = numbered.withColumn("_chunk", _chunk(F.col("pos")))
    return (
        join_null_safe(chunked, touched, ["id", "_chunk"], "left")
        .filter(F.col("_cut").isNull() | (F.col("ord") < F.col("_cut")))
        .drop("_chunk", "_cut")
    )


def _with_fact(numbered: DataFrame, facts: DataFrame) -> DataFrame:
    """Turns with what is known of their conversation: ``facts`` has ``id`` and other columns.

    Facts go to the chunks of their conversation first, so that turns of a long one meet them
    under many keys.
    """
    chunked = numbered.withColumn("_chunk", _chunk(F.col("pos")))
    chunks = join_null_safe(chunked.select("id", "_chunk").distinct(), facts, ["id"])
    return join_null_safe(chunked, chunks, ["id", "_chunk"], "left").drop("_chunk")


def _human_at(i: int) -> Column:
    return F.coalesce(F.get("tail", F.lit(i))["code"] == 1, F.lit(False))


def _empty_reply_at(i: int) -> Column:
    t = F.get("tail", F.lit(i))
    return F.coalesce((t["code"] == 2) & (t["empty"] == 1), F.lit(False))


def _turn_at(i: int) -> Column:
    return F.get("tail", F.lit(i))


def drop_trailing_human(numbered: DataFrame) -> DataFrame:
    """Remove the last turn of a conversation when a human spoke it."""
    return _cut_tail(numbered, F.when(_human_at(0), _turn_at(0)))


def drop_trailing_empty_reply(numbered: DataFrame) -> DataFrame:
    """Remove a last reply without text together with the question before it; once."""
    return _cut_tail(numbered, F.when(_empty_reply_at(0) & _human_at(1), _turn_at(1)))


def clean_conversations(numbered: DataFrame) -> DataFrame:
    """Trailing human turn first, then the trailing empty exchange, in a single pass."""
    after_human = F.when(_empty_reply_at(1) & _human_at(2), _turn_at(2)).otherwise(_turn_at(0))
    plain = F.when(_empty_reply_at(0) & _human_at(1), _turn_at(1))
    return _cut_tail(numbered, F.when(_human_at(0), after_human).otherwise(plain))


def drop_leading_non_human(numbered: DataFrame) -> DataFrame:
    """Remove a first turn not spoken by a human and close the gap in the ranks."""
    led = (
        numbered.filter((F.col("ord") == 0) & ~F.col("from").eqNullSafe(HUMAN))
        .select("id", F.lit(1).alias("_lead"))
        .distinct()
    )
    return (
        _with_fact(numbered, led)
        .withColumn("ord", F.col("ord") - F.coalesce("_lead", F.lit(0)))
        .filter(F.col("ord") >= 0)
        .drop("_lead")
    )


def map_roles(turns: DataFrame, reply_role: str, on_error: str = "fail") -> DataFrame:
    """Add ``role``; an unknown speaker fails the job, is dropped, or keeps a null role."""
    role = chat_role(F.col("from"), reply_role)
    if on_error == "fail":
        unknown = F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce("from", F.lit("null"))))
        return turns.withColumn("role", F.coalesce(role, unknown.cast("string")))
    turns = turns.withColumn("role", role)
    if on_error == "drop":
        return turns.filter(F.col("role").isNotNull())
    if on_error == "quarantine":
        return turns
    raise ValueError(f"unknown on_error: {on_error}")


def _in_turn(ord_: Column, speaker: Column) -> Column:
    return speaker.eqNullSafe(F.when(ord_ % 2 == 0, F.lit(HUMAN)).otherwise(F.lit(REPLY)))


def check_alternation(numbered: DataFrame, on_error: str = "fail") -> DataFrame:
    """Require human, reply, human, ... by rank.

    ``fail`` raises on the first turn out of order, ``drop`` removes the conversations that
    have one, ``quarantine`` keeps everything and adds a boolean ``alternates`` per
    conversation.
    """
    in_turn = _in_turn(F.col("ord"), F.col("from"))
    if on_error == "fail":
        broken = F.raise_error(F.concat(F.lit("turns out of order in "), F.col("id")))
        return numbered.filter(F.when(in_turn, True).otherwise(broken.cast("boolean")))
    if on_error not in ("drop", "quarantine"):
        raise ValueError(f"unknown on_error: {on_error}")
    broken_ids = numbered.filter(~in_turn).select("id", F.lit(True).alias("_broken")).distinct()
    marked = _with_fact(numbered, broken_ids).withColumn("alternates", F.col("_broken").isNull())
    if on_error == "drop":
        marked = marked.filter("alternates").drop("alternates")
    return marked.drop("_broken")


def inject_system(numbered: DataFrame, text: str) -> DataFrame:
    """Put a system turn in front of every conversation; other turns move back by one.

    Each conversation's own first turn brings the system turn along, so nothing is
    grouped, joined or shuffled.
    """
    other = [c for c in numbered.columns if c not in ("ord", "from", "value")]

    def turn(ord_: Column, speaker: Column, value: Column) -> Column:
        return F.struct(
            ord_.cast("bigint").alias("ord"), speaker.alias("from"), value.alias("value")
        )

    own = turn(F.col("ord") + 1, F.col("from"), F.col("value"))
    system = turn(F.lit(0), F.lit("system"), F.lit(text))
    turns = F.when(F.col("ord") == 0, F.array(system, own)).otherwise(F.array(own))
    return numbered.select(*other, F.explode(turns).alias("_t")).select(
        *other, F.col("_t.ord").alias("ord"), F.col("_t.from").alias("from"),
        F.col("_t.value").alias("value"),
    )


def collect_turns(turns: DataFrame, order: str = "pos") -> DataFrame:
    """One record per conversation, of any length, with its turns in order: ``id, conversations``.

    A record is one row by definition. Work that can do without belongs on the turn table.
    """
    turn = F.struct(F.col(order).alias("_o"), F.col("from"), F.col("value"))
    plain = F.transform(
        "_turns", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))
    )
    grouped = turns.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select("id", plain.alias("conversations"))
