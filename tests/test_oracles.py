"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from dialoom.catalog import queries as catalog
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


def _clean(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    columns = sorted(result.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    picked = expected.select(*[duckdb.ColumnExpression(c) for c in columns])
    want = _sorted([tuple(map(_clean, r)) for r in picked.fetchall()])
    got = _sorted([tuple(r) for r in result.select(*[f"`{c}`" for c in columns]).collect()])
    assert len(got) > 0
    assert got == want


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["draft_id", "token_id", "offset", "freq"]
    assert result.count() == 500


LONG = [
    "render_chat", "render_chat_gemma", "split_rounds", "record_counts", "load_conversations",
    "collect_turns", "write_jsonl", "stream_clean", "coalesce_turn_fields", "clean_conversations",
    "clean_records", "drop_leading_non_human", "check_alternation", "write_batches", "loss_mask",
    "loss_mask_uncapped", "build_draft_vocab", "trimmed_mean_latency",
]


@pytest.fixture(scope="module")
def hard_folder(tmp_path_factory):
    """The smallest tables with a conversation of 5,000 turns and a group without a name."""
    folder = tmp_path_factory.mktemp("hard")
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '{SF}/{name}.parquet'"
        if name == "conversations":
            rows += """ UNION ALL SELECT 100000, range, CASE WHEN range % 2 = 0 THEN 'user' ELSE 'assistant' END,
                'turn ' || range || ' of many' FROM range(5000)"""
        if name == "events":
            rows = rows.replace("*", "* REPLACE (CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS event_type)")
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", LONG)
def test_long_conversations_and_null_groups(spark, hard_folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hard_folder}/{t}.parquet'")
    result = entry.queries()[name](spark, hard_folder)
    columns = sorted(result.columns)
    expected = con.sql(entry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in columns])
    want = _sorted([tuple(map(_clean, r)) for r in expected.fetchall()])
    got = _sorted([tuple(r) for r in result.select(*[f"`{c}`" for c in columns]).collect()])
    assert got == want


@pytest.fixture(scope="module")
def repeated_folder(tmp_path_factory):
    """Two conversations without an id, one written twice, one that ends in a human turn."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '{SF}/{name}.parquet'"
        if name == "conversations":
            said = "CASE WHEN range % 2 = 0 THEN 'user' ELSE 'assistant' END, 'turn ' || range"
            for conv_id, turns, times in (("NULL", 7, 2), ("200001", 5, 2), ("200011", 4, 3), ("NULL", 9000, 1)):
                rows += f" UNION ALL SELECT {conv_id}, range, {said} FROM range({turns}), range({times}) AS t(k)"
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize(
    "name", ["drop_trailing_human", "clean_conversations", "drop_leading_non_human", "check_alternation"]
)
def test_null_and_repeated_ids(spark, repeated_folder, name):
    """Rows that share an id and a place are not multiplied, and one turn at the end is one row."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{repeated_folder}/{t}.parquet'")
    result = entry.queries()[name](spark, repeated_folder)
    columns = sorted(result.columns)
    expected = con.sql(entry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in columns])
    got = _sorted([tuple(r) for r in result.select(*[f"`{c}`" for c in columns]).collect()])
    assert got == _sorted([tuple(map(_clean, r)) for r in expected.fetchall()])
