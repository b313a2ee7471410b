import random

import pytest

# Names that operators use inside; a table may have them as columns of its own.
EXTRA = ("score", "bucket", "found", "n", "digest", "prefix", "set", "h", "ratio", "_words", "_id", "_pii_email", "length", "piece", "shard", "slot", "crc", "component")


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(words))


def hard_rows():
    """Null ids and texts, empty and blank texts, copies, repeated rows, a very long text."""
    base = prose(1, 120)
    return [
        (1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, None),
        (7, "x"), (8, "two words"), (9, "é日本 " * 30), (10, prose(2, 60_000)), (11, "a" * 30_000), (12, "same " * 400),
        (13, "card 4111 1111 1111 1111 mail a.b@c.example.org ip 10.0.0.255 call +1 (555) 123-4567"), (-5, prose(3, 40)),
    ]


@pytest.fixture
def table_of(spark):
    """A documents table with extra columns whose names clash with inner ones."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if extra:
            for name in EXTRA:
                df = df.selectExpr("*", f"cast(null as string) AS `{name}`")
        return df

    return make


@pytest.fixture
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
