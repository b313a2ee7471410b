"""Token ids, supervision masks and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions import masks
from dialoom.functions.text import (
    ChatTemplate,
    render_chat,
    rounds,
    stripped,
    usable_rounds,
)
from dialoom.functions.tokens import Tokenizer
from dialoom.operators import records, turn_table


def chat_texts(conv: DataFrame, template: ChatTemplate, on_error: str = "fail") -> DataFrame:
    """Records ready to train on, as ``messages`` and the rendered ``text``."""
    ready = records.trainable_turns(conv, on_error)
    return records.to_messages(ready, template.reply_role, template.system).withColumn(
        "text", render_chat(F.col("messages"), template)
    )


def tokenize(
    df: DataFrame, tokenizer: Tokenizer, max_len: int | None = None, text: str = "text"
) -> DataFrame:
    """Add ``input_ids``; with ``max_len`` at most as many."""
    return df.withColumn("input_ids", tokenizer.capped_ids(F.col(text), max_len))


def split_rounds(df: DataFrame, template: ChatTemplate, column: str = "rounds") -> DataFrame:
    """Add the usable rounds of a rendered ``text``: ``array<struct<round, instruction, reply>>``.

    A round runs from one user header to the next and is usable with exactly one reply; the
    list ends before the first round that is not.
    """
    return df.withColumn(column, usable_rounds(rounds(F.col("text"), template), template))


def _content_pieces(template: ChatTemplate, tokenizer: Tokenizer) -> Column:
    """Sizes of header, body and end of every message, as ``struct<size, reply>``."""
    sizes = tokenizer.counts(
        F.flatten(
            F.transform(
                "messages",
                lambda m, i: F.array(
                    F.concat(
                        F.when(i == 0, F.lit(template.prefix)).otherwise(F.lit("")),
                        template.header(m["role"]),
                    ),
                    stripped(m["content"]),
                    F.lit(template.end),
                ),
            )
        )
    )

    def piece(size: Column, i: Column) -> Column:
        message = F.get("messages", F.floor(i / 3).cast("int"))
        reply = (message["role"] == template.reply_role) & (i % 3 == 1)
        return F.struct(size.alias("size"), reply.alias("reply"))

    return F.transform(sizes, piece)


def loss_mask(
    df: DataFrame,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    policy: str = "reference",
    tokens: str = "input_ids",
) -> DataFrame:
    """Add ``loss_mask``, aligned with ``tokens``: 1 where the next token is supervised.

    ``reference`` counts tokens round by round with fixed offsets and stops at the first
    round without exactly one reply; with the Gemma template that leaves chats of several
    rounds unsupervised. ``content`` marks the body of every reply for both templates.
    """
    n = F.size(tokens)
    if policy == "content":
        return df.withColumn("_pieces", _content_pieces(template, tokenizer)).withColumn(
            "loss_mask", masks.content_mask(n, F.col("_pieces"))
        ).drop("_pieces")
    if policy != "reference":
        raise ValueError(f"unknown policy: {policy}")
    begin = tokenizer.begin_tokens
    return (
        split_rounds(df, template, "_rounds")
        .withColumns(
            {
                "_round_n": tokenizer.counts(F.transform("_rounds", lambda r: r["round"])),
                "_instr_n": tokenizer.counts(F.transform("_rounds", lambda r: r["instruction"])),
            }
        )
        .withColumn(
            "_starts",
            masks.round_starts(F.transform("_round_n", lambda c: (c + begin).cast("int"))),
        )
        .withColumn(
            "_ends",
            masks.zero_ends(
                F.col("_starts"), F.transform("_instr_n", lambda c: c + (begin - 1))
            ),
        )
        .withColumn(
            "loss_mask", masks.stretch_mask(n, masks.zero_starts(F.col("_starts")), F.col("_ends"))
        )
        .drop("_rounds", "_round_n", "_instr_n", "_starts", "_ends")
    )


def attention_mask(df: DataFrame) -> DataFrame:
    """Add ``attention_mask``: all ones, as long as ``input_ids``."""
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def project_features(df: DataFrame, attention: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the feature columns (and those asked to be kept)."""
    columns = ["input_ids", "loss_mask", *(["attention_mask"] if attention else [])]
    return df.select(*keep, *columns)


def featurize(
    conv: DataFrame,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    max_len: int | None = None,
    policy: str = "reference",
    on_error: str = "fail",
    keep: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Records to feature rows; no shuffle."""
    texts = chat_texts(conv, template, on_error)
    masked = loss_mask(tokenize(texts, tokenizer, max_len), template, tokenizer, policy)
    return project_features(attention_mask(masked), keep=keep)


def trainable_records(turns: DataFrame) -> DataFrame:
    """Turn table to cleaned records ``id, conversations``, ready for ``featurize``.

    Conversations of all lengths are nested once and cleaned in place.
    """
    nested = turn_table.collect_turns(turns)
    return records.clean_conversations(records.keep_dialogue_roles(nested))


def cleaned_records(turns: DataFrame) -> DataFrame:
    """Turn table to cleaned records, empty ones included."""
    return trainable_records(turns)


def shift_tokens(df: DataFrame, column: str, left: bool) -> DataFrame:
    """``left=False`` drops the first element and appends 0; ``left=True`` the mirror image."""
    shift = masks.shift_right if left else masks.shift_left
    return df.withColumn(column, shift(F.col(column)))


def pad_batch(df: DataFrame, *batch: str) -> DataFrame:
    """Right-pad ids and masks with 0 to the longest row of the batch.

    A batch is a training micro-batch: a handful of rows, so its window stays small.
    """
    columns = [c for c in ("input_ids", "attention_mask", "loss_mask") if c in df.columns]
    widest = F.max(F.size("input_ids")).over(Window.partitionBy(*batch))
    padded = df.withColumn("_width", widest)
    return padded.withColumns({c: masks.pad_right(F.col(c), F.col("_width")) for c in columns}).drop(
        "_width"
    )
