"""Supervision masks and array padding as native array expressions.

A mask is assembled from runs of zeros and ones (``array_repeat``), so its cost grows with
its length and not with length times rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _run(bit: int, length: Column) -> Column:
    return F.array_repeat(F.lit(bit), F.greatest(length, F.lit(0)).cast("int"))


# The offsets below belong to the Llama chat format and are also used for
# Gemma chats; both masks depend on them.
FIRST_ROUND_SHORTER = 2
LATER_ROUND_EARLIER = 3
LATER_ROUND_LONGER = 1
BETWEEN_ROUNDS = 3


# Running sums grow one array per block of rounds, so their cost is the block times the rounds.
SUM_BLOCK = 256


def _grown(first: Column, values: Column) -> Column:
    """``first`` and the running sums behind it."""
    return F.aggregate(
        values,
        F.array(first),
        lambda acc, v: F.concat(acc, F.array((F.element_at(acc, -1) + v).cast("int"))),
    )


def running_sums(first: int, values: Column) -> Column:
    """``first``, ``first`` plus the first value, and so on: one entry more than ``values``."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / SUM_BLOCK).cast("int")),
        lambda b: F.slice(values, b * SUM_BLOCK + 1, SUM_BLOCK),
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: (a + v).cast("int")))
    begins = _grown(F.lit(first), totals)
    inner = F.transform(
        blocks, lambda b, i: F.slice(_grown(F.get(begins, i), b), F.lit(2), F.greatest(F.size(b), F.lit(0)))
    )
    return F.concat(F.array(F.lit(first)), F.flatten(inner))


def round_starts(round_lengths: Column) -> Column:
    """Token offset of every usable round, plus the offset behind the last one."""
    steps = F.transform(
        round_lengths, lambda n, i: (n + F.when(i > 0, BETWEEN_ROUNDS).otherwise(0)).cast("int")
    )
    return running_sums(1, steps)


def zero_ends(starts: Column, instruction_lengths: Column) -> Column:
    """Where the unsupervised stretch of each round stops."""

    def end(length: Column, i: Column) -> Column:
        start = F.get(starts, i)
        return F.when(
            i == 0, F.greatest(F.lit(1), start + length - FIRST_ROUND_SHORTER)
        ).otherwise(start + length + LATER_ROUND_LONGER)

    return F.transform(instruction_lengths, end)


def zero_starts(starts: Column) -> Column:
    """Where each unsupervised stretch begins; the last entry is the tail behind all rounds."""
    last = F.size(starts) - 1
    return F.transform(
        starts,
        lambda s, i: F.when((i == 0) | (i == last), s).otherwise(s - LATER_ROUND_EARLIER),
    )


def stretch_mask(n: Column, begins: Column, ends: Column) -> Column:
    """Mask of length ``n`` from the stretches of ``zero_starts`` and ``zero_ends``."""

    def stretch(end: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(1)).otherwise(
            F.greatest(F.get(begins, i), F.get(ends, i - 1))
        )
        zeros = F.least(end, n) - F.least(before, n)
        ones = F.least(F.get(begins, i + 1), n) - F.least(end, n)
        return F.concat(_run(0, zeros), _run(1, ones))

    body = F.flatten(F.transform(ends, stretch))
    return F.slice(F.concat(F.array(F.lit(0)), body, _run(0, n)), F.lit(1), n)


def content_mask(n: Column, pieces: Column) -> Column:
    """Mask of length ``n`` that is 1 where the next token is reply text.

    ``pieces`` is ``array<struct<size int, reply boolean>>`` covering the text in order.
    """
    bits = F.flatten(
        F.transform(
            pieces,
            lambda p: F.array_repeat(
                F.when(p["reply"], F.lit(1)).otherwise(F.lit(0)), p["size"].cast("int")
            ),
        )
    )
    following = F.slice(bits, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.slice(F.concat(following, _run(0, n)), F.lit(1), n)


def shift_left(values: Column) -> Column:
    """Drop the first element and append 0."""
    return F.when(
        F.size(values) > 0,
        F.concat(F.slice(values, F.lit(2), F.size(values)), F.array(F.lit(0))),
    ).otherwise(values)


def shift_right(values: Column) -> Column:
    """Prepend 0 and drop the last element."""
    return F.when(
        F.size(values) > 0,
        F.concat(F.array(F.lit(0)), F.slice(values, F.lit(1), F.size(values) - 1)),
    ).otherwise(values)


def pad_right(values: Column, length: Column) -> Column:
    return F.concat(values, _run(0, length - F.size(values)))
