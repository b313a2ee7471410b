"""Tokenizers: one built from native expressions, and a plug-in for real ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from dialoom.functions.hashing import hex_prefix_number

# Fixed value: special markers, line breaks, runs of text, a lone bracket.
PATTERN = r"<\|[a-z_]+\|>|<[a-z_]+>|\n\n|\n|[^\s<]+|<"


@dataclass(frozen=True)
class RegexTokenizer:
    """Words by pattern, ids by hash. No Python runs per row."""

    vocab_size: int = 4096
    pattern: str = PATTERN
    begin_tokens: int = 1

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def word_id(self, word: Column) -> Column:
        return (hex_prefix_number(F.md5(word), 6) % self.vocab_size).cast("int")

    def ids(self, text: Column) -> Column:
        return F.transform(self.words(text), self.word_id)

    def capped_ids(self, text: Column, max_len: int | None) -> Column:
        """Only the words that are kept get hashed."""
        words = self.words(text)
        if max_len is not None:
            words = F.slice(words, 1, max_len)
        return F.transform(words, self.word_id)

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.size(self.words(t)))


@dataclass(frozen=True)
class BatchTokenizer:
    """A real tokenizer behind Arrow batches.

    ``encode`` takes a list of texts and returns a list of id lists, without special
    tokens added. It is shipped to the executors, so it should load its model lazily.
    """

    encode: Callable[[list[str]], Sequence[Sequence[int]]]
    vocab_size: int
    begin_tokens: int = 1

    def ids(self, text: Column) -> Column:
        encode = self.encode

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def to_ids(batch: pd.Series) -> pd.Series:
            return pd.Series([list(ids) for ids in encode(batch.fillna("").tolist())])

        return to_ids(text)

    def capped_ids(self, text: Column, max_len: int | None) -> Column:
        ids = self.ids(text)
        return ids if max_len is None else F.slice(ids, 1, max_len)

    def counts(self, texts: Column) -> Column:
        encode = self.encode

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def to_counts(batch: pd.Series) -> pd.Series:
            flat = [t for row in batch for t in row]
            sizes = iter([len(ids) for ids in encode(flat)] if flat else [])
            return pd.Series([[next(sizes) for _ in row] for row in batch])

        return to_counts(texts)


Tokenizer = RegexTokenizer | BatchTokenizer
