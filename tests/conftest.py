import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("dialoom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conv(spark):
    """Records from ``{id: [(speaker, value), ...]}``."""

    def make(records):
        rows = [
            (i, None if turns is None else [{"from": f, "value": v} for f, v in turns])
            for i, turns in records.items()
        ]
        schema = "id string, conversations array<struct<`from`:string,value:string>>"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def turns(spark):
    """A turn table from the same form."""

    def make(records):
        rows = [
            (i, p, f, v) for i, turns in records.items() for p, (f, v) in enumerate(turns)
        ]
        return spark.createDataFrame(rows, "id string, pos bigint, `from` string, value string")

    return make


def as_dict(df):
    return {
        r["id"]: [(t["from"], t["value"]) for t in r["conversations"]] for r in df.collect()
    }
