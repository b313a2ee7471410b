"""Seeded hashes that give the same answer on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed: int, *keys: Column) -> Column:
    """Hex digest of ``seed:key[:key...]``; null keys count as empty text."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_prefix_number(digest: Column, digits: int) -> Column:
    """First hex digits of a digest as a bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hex_threshold(p: float) -> str:
    """Eight hex digits t such that ``digest[:8] < t`` holds with probability ``p``."""
    if not 0 <= p <= 1:
        raise ValueError(f"probability out of range: {p}")
    return f"{min(int(p * 2**32), 2**32 - 1):08x}"
