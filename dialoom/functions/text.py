"""Prompt transcripts, chat templates and the split of a rendered chat into rounds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from dialoom.functions.turns import let
from dialoom.schema import HUMAN, SYSTEM_PROMPT

# Fixed value: the characters a chat template strips around a message.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class ChatTemplate:
    """How a list of role/content messages becomes one string."""

    name: str
    prefix: str
    header_open: str
    header_close: str
    end: str
    reply_role: str
    user_sep: str
    reply_sep: str
    system: str | None = None

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.header_open), role, F.lit(self.header_close))


# Special tokens and separators of the two chat formats.
LLAMA = ChatTemplate(
    name="llama",
    prefix="<|begin_of_text|>",
    header_open="<|start_header_id|>",
    header_close="<|end_header_id|>\n\n",
    end="<|eot_id|>",
    reply_role="assistant",
    user_sep="<|eot_id|><|start_header_id|>user<|end_header_id|>",
    reply_sep="<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    system=SYSTEM_PROMPT,
)
GEMMA = ChatTemplate(
    name="gemma",
    prefix="<bos>",
    header_open="<start_of_turn>",
    header_close="\n",
    end="<end_of_turn>\n",
    reply_role="model",
    user_sep="<end_of_turn>\n<start_of_turn>user\n",
    reply_sep="<end_of_turn>\n<start_of_turn>model\n",
)


def quoted(literal: str) -> str:
    """A Java/RE2 pattern that matches ``literal`` and nothing else."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def stripped(content: Column) -> Column:
    return F.btrim(F.coalesce(content, F.lit("")), F.lit(WHITESPACE))


def render_message(message: Column, template: ChatTemplate) -> Column:
    return F.concat(
        template.header(message["role"]), stripped(message["content"]), F.lit(template.end)
    )


def render_chat(messages: Column, template: ChatTemplate) -> Column:
    """The whole chat as one string, without a trailing generation prompt."""
    rendered = F.transform(messages, lambda m: render_message(m, template))
    return F.concat(F.lit(template.prefix), F.array_join(rendered, ""))


def transcript_line(speaker: Column, text: Column) -> Column:
    label = F.when(speaker == HUMAN, "Human: ").otherwise("Assistant: ")
    return F.concat(label, F.coalesce(text, F.lit("")), F.lit("\n\n"))


def transcript(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: transcript_line(t["from"], t["value"])), "")


def reply_prompt(earlier_turns: Column) -> Column:
    """What the generator sees before the reply that follows ``earlier_turns``."""
    return F.concat(transcript(earlier_turns), F.lit("Assistant:"))


def rounds(text: Column, template: ChatTemplate) -> Column:
    """Rendered chat cut at user headers, the opening piece joined to the first round."""

    def join_first(pieces: Column) -> Column:
        first = F.concat(F.get(pieces, 0), F.lit(template.user_sep), F.get(pieces, 1))
        rest = F.slice(pieces, F.lit(3), F.size(pieces))
        return F.when(F.size(pieces) >= 2, F.concat(F.array(first), rest)).otherwise(pieces)

    return let(F.split(text, quoted(template.user_sep), -1), join_first)


def usable_rounds(all_rounds: Column, template: ChatTemplate) -> Column:
    """Leading rounds that hold exactly one reply, as ``struct<round, instruction, reply>``."""
    sep = quoted(template.reply_sep)

    def cut(r: Column) -> Column:
        return F.struct(r.alias("round"), F.split(r, sep, -1).alias("parts"))

    def named(r: Column) -> Column:
        return F.struct(
            r["round"].alias("round"),
            F.concat(F.get(r["parts"], 0), F.lit(template.reply_sep)).alias("instruction"),
            F.get(r["parts"], 1).alias("reply"),
        )

    def leading(cuts: Column) -> Column:
        fits = F.transform(cuts, lambda r: (r["round"] != "") & (F.size(r["parts"]) == 2))
        first_bad = F.array_position(fits, F.lit(False))
        count = F.coalesce(F.nullif(first_bad, F.lit(0)) - 1, F.size(cuts)).cast("int")
        return F.transform(F.slice(cuts, F.lit(1), count), named)

    return let(F.transform(all_rounds, cut), leading)


def word_count(text: Column) -> Column:
    """Whitespace-separated words of ``text``."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
