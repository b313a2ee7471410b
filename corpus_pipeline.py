"""A training corpus from raw documents: five stages, each by one operator of ``dialoom.llm``.

Every stage takes the documents that its predecessor kept. All but the last return the columns of
``documents``, whatever they are; the last returns packed pieces. Between stages the documents are
written as Parquet in the shared folder, which also cuts lineage. Rows with null ids or texts pass
the filters (there is nothing to hold against them) and are packed like others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.llm.common import table
from dialoom.llm.decontamination import without_leaks
from dialoom.llm.jaccard import keep_one
from dialoom.llm.packing import pack_documents
from dialoom.llm.pii import redact
from dialoom.llm.toxicity import held_out, learn, toxicity_score
from dialoom.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.5  # score from which a document goes
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
CACHED_CHUNKS = 200_000  # by a task that packs: workers hold what other stages left as well


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below ``TOXIC``; held-out labels teach nothing."""
    labels = table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    return docs.filter(toxicity_score(F.col("text"), model) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    return keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, edits within its budget included."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=CACHED_CHUNKS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

# No stage but the fourth is within reach of SQL; a test compares the rows of run(), stage by stage,
# with plain Python on planted documents (packing: the tokens of each document and its free places).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
