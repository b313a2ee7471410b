"""Expressions over a conversation held as one array of turns.

All of them are narrow: a record is cleaned where it was read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from dialoom.schema import HUMAN, HUMAN_SPELLINGS, REPLY, REPLY_SPELLINGS

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it.

    Filters on a derived column are moved below the projection that made it and repeat its
    expression; bound this way the repetition stays linear along a chain of steps.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def turns_or_none(conv: Column) -> Column:
    """Null conversations count as conversations without turns."""
    return F.coalesce(conv, F.array())


def _speaker_from_end(conv: Column, back: int) -> Column:
    return F.try_element_at(conv, F.lit(-back))["from"]


def _without_last(conv: Column, n: int) -> Column:
    return F.slice(conv, F.lit(1), F.size(conv) - n)


def drop_trailing_human(conv: Column) -> Column:
    return let(
        turns_or_none(conv),
        lambda c: F.when(_speaker_from_end(c, 1) == HUMAN, _without_last(c, 1)).otherwise(c),
    )


def drop_trailing_empty_reply(conv: Column) -> Column:
    def cut(c: Column) -> Column:
        reply = F.try_element_at(c, F.lit(-1))
        empty = F.coalesce(reply["value"], F.lit("")) == ""
        hit = (reply["from"] == REPLY) & empty & (_speaker_from_end(c, 2) == HUMAN)
        return F.when(hit, _without_last(c, 2)).otherwise(c)

    return let(turns_or_none(conv), cut)


def drop_leading_non_human(conv: Column) -> Column:
    def cut(c: Column) -> Column:
        lead = F.try_element_at(c, F.lit(1))["from"]
        return F.when(
            (F.size(c) > 0) & ~lead.eqNullSafe(HUMAN), F.slice(c, F.lit(2), F.size(c))
        ).otherwise(c)

    return let(turns_or_none(conv), cut)


def canonical_speaker(role: Column) -> Column:
    """Both spellings to ``human``/``gpt``; any other role to null."""
    return F.when(role.isin(*HUMAN_SPELLINGS), HUMAN).when(role.isin(*REPLY_SPELLINGS), REPLY)


def keep_dialogue_roles(conv: Column) -> Column:
    spoken = F.filter(conv, lambda t: canonical_speaker(t["from"]).isNotNull())
    return F.transform(
        spoken,
        lambda t: F.struct(canonical_speaker(t["from"]).alias("from"), t["value"].alias("value")),
    )


def chat_role(speaker: Column, reply_role: str) -> Column:
    """``human`` to user, ``gpt`` to the template's reply role, else null."""
    return F.when(speaker == HUMAN, "user").when(speaker == REPLY, reply_role)


def map_roles(conv: Column, reply_role: str) -> Column:
    """Turns as ``struct<role, content>``; an unknown speaker fails the task."""

    def mapped(t: Column) -> Column:
        role = chat_role(t["from"], reply_role)
        unknown = F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(t["from"], F.lit("null"))))
        return F.struct(
            F.coalesce(role, unknown.cast("string")).alias("role"), t["value"].alias("content")
        )

    return F.transform(conv, mapped)


def known_roles(conv: Column) -> Column:
    return F.forall(conv, lambda t: canonical_speaker(t["from"]).eqNullSafe(t["from"]))


def alternates(conv: Column) -> Column:
    """True when even positions are ``human`` and odd ones ``gpt``."""
    flags = F.transform(
        conv,
        lambda t, i: t["from"].eqNullSafe(F.when(i % 2 == 0, F.lit(HUMAN)).otherwise(F.lit(REPLY))),
    )
    return F.forall(flags, lambda ok: ok)


def falls_through(*choices: Column) -> Column:
    """First choice that is neither null nor empty text; null when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def inject_system(messages: Column, text: str) -> Column:
    system = F.struct(F.lit("system").alias("role"), F.lit(text).alias("content"))
    return F.concat(F.array(system), messages)
