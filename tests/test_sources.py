import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialoom.schema import LOOSE_CONVERSATION
from dialoom.sources import conversations as src
from dialoom.sources import sinks
from tests.conftest import as_dict

H, G = "human", "gpt"
RECORDS = [
    {"id": "a_1", "conversations": [{"from": H, "value": "é }\n  },\n ]"}, {"from": G, "value": "[{"}]},
    {"id": "a_2", "conversations": []},
    {"id": None, "conversations": [{"from": H, "value": None}]},
]
WANT = {
    "a_1": [(H, "é }\n  },\n ]"), (G, "[{")], "a_2": [], None: [(H, None)],
}


def test_jsonl_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = [json.dumps(r, ensure_ascii=False) for r in RECORDS]
    path.write_text(lines[0] + "\n\n   \n" + lines[1] + "\n" + lines[2] + "\n")
    assert as_dict(src.load_conversations(spark, str(path))) == WANT
    assert src.scan_records_variant(spark, str(path)).count() == 3
    path.write_text(lines[0] + "\n{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="x.jsonl"):
        src.load_conversations(spark, str(path)).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, tmp_path, indent):
    path = tmp_path / "x.json"
    path.write_text(json.dumps(RECORDS, ensure_ascii=False, indent=indent))
    assert as_dict(src.load_conversations(spark, str(path))) == WANT


@pytest.mark.parametrize("count", [0, 1, 2, 3, 500])
def test_indented_array_is_cut_at_records(spark, tmp_path, count):
    records = [dict(RECORDS[i % 3], id=f"r_{i}") for i in range(count)]
    for name in ("x.json", "y.json"):
        (tmp_path / name).write_text(json.dumps(records, ensure_ascii=False, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = src.scan_conversations_json(spark, str(tmp_path), layout="indented")
        got = sorted((r["id"], json.dumps([t.asDict() for t in r["conversations"]])) for r in df.collect())
        assert count < 500 or df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((r["id"], json.dumps(r["conversations"])) for r in records * 2)
    assert got == want


def test_parquet_dir_is_not_recursive(spark, tmp_path, conv):
    conv({"a": [(H, "q")]}).write.parquet(str(tmp_path / "ultra"))
    (tmp_path / "ultra" / "notes.txt").write_text("no parquet")
    assert as_dict(src.load_conversations(spark, str(tmp_path / "ultra"))) == {"a": [(H, "q")]}


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        src.load_conversations(spark, "x.csv")
    with pytest.raises(ValueError):
        src.load_conversations(spark, "x.jsonl", fmt="orc")


def test_spellings(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    rows = [
        {"id": "plain", "conversations": [{"from": H, "value": "1"}], "items": [{"from": G}]},
        {"id": "items", "conversations": [], "items": [{"role": "user", "content": "1"}]},
        {"id": "messages", "messages": [{"from": "", "role": "assistant", "value": "", "content": "2"}]},
        {"id": "both", "items": [], "messages": [{"role": "user", "content": "2"}]},
        {"id": "none"},
    ]
    path.write_text("\n".join(map(json.dumps, rows)))
    loose = src.scan_conversations_jsonl(spark, str(path), LOOSE_CONVERSATION)
    assert as_dict(src.coalesce_turn_fields(loose)) == {
        "plain": [(H, "1")], "items": [("user", "1")], "messages": [("assistant", "2")],
        "both": [], "none": [],
    }


def test_missing_and_null_ids(spark):
    rows = [(0, '{"id": "x"}'), (1, '{"id": null}'), (2, "{}"), (3, '{"id": 5}')]
    df = spark.createDataFrame(rows, "idx bigint, text string")
    made = src.default_id(df.withColumn("record", F.parse_json("text"))).orderBy("idx")
    assert [r["id"] for r in made.collect()] == ["x", None, "regenerated_2", "5"]


def test_content_kinds(spark):
    cases = [
        ('"[1]"', "[1]"),
        ('["1"]', "1"),
        ('["a", "b"]', "a\nb"),
        ('[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]', "ab"),
        ("12", "12"),
        ('{"a": [1, null]}', '{"a":[1,null]}'),
        ('["a", 1]', '["a",1]'),
        ('[{"type": "image"}]', '[{"type":"image"}]'),
        ("[]", ""),
        ("true", "true"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    out = src.normalize_content(df.withColumn("body", F.parse_json("body")), "body")
    assert [r["body"] for r in out.orderBy("i").collect()] == [c[1] for c in cases]


def test_written_lines_keep_nulls(spark, tmp_path, conv):
    path = str(tmp_path / "out")
    sinks.write_jsonl(conv({"a": [(H, None)]}), path)
    line = spark.read.text(path).collect()[0][0]
    assert json.loads(line) == {"id": "a", "conversations": [{"from": H, "value": None}]}


def _indexed(spark, ids):
    rows = [(i, n, [{"from": H, "value": i}]) for n, i in enumerate(ids)]
    return spark.createDataFrame(
        rows, "id string, idx bigint, conversations array<struct<`from`:string,value:string>>"
    )


def test_batches_round_trip(spark, tmp_path):
    df = _indexed(spark, [f"r_{i}" for i in range(23)])
    path = str(tmp_path / "batches")
    sinks.write_batches(df.filter("idx < 11"), path, 10)
    sinks.write_batches(df.filter("idx >= 11"), path, 10, mode="append")
    merged = sinks.merge_batches(sinks.scan_batches(spark, path)).collect()
    assert [(r["idx"], r["batch_start"]) for r in merged] == [(i, i // 10 * 10) for i in range(23)]


def test_merge_keeps_the_latest_row_of_an_index(spark):
    """Records that share an id are different records; overlapping saves share an index."""
    first = sinks.assign_batches(_indexed(spark, ["a", "b", "b", None, None]), 10)
    later = _indexed(spark, ["a"]).withColumn("batch_start", F.lit(50).cast("bigint"))
    batches = first.unionByName(later).unionByName(later)
    merged = [(r["id"], r["batch_start"], r["idx"]) for r in sinks.merge_batches(batches).collect()]
    assert merged == [("b", 0, 1), ("b", 0, 2), (None, 0, 3), (None, 0, 4), ("a", 50, 0)]
    assert sinks.merge_batches(batches, dedupe=None).count() == 7


def test_merge_prefers_rows_without_failures(spark):
    rows = [("a", 0, 0, ["no route"]), ("a", 0, 0, [None]), ("b", 1, 0, [None]), ("b", 1, 9, ["busy"])]
    df = spark.createDataFrame(rows, "id string, idx bigint, batch_start bigint, errors array<string>")
    got = sorted((r["id"], r["batch_start"], r["errors"]) for r in sinks.merge_batches(df).collect())
    assert got == [("a", 0, [None]), ("b", 0, [None])]


@pytest.mark.parametrize("spelling", ["compact", "four", "crlf"])
def test_other_layouts_are_refused(spark, tmp_path, spelling):
    records = [{"id": f"r_{i}", "conversations": [{"from": H, "value": str(i)}]} for i in range(5)]
    text = {
        "compact": json.dumps(records),
        "four": json.dumps(records, indent=4),
        "crlf": json.dumps(records, indent=2).replace("\n", "\r\n"),
    }[spelling]
    path = tmp_path / "x.json"
    path.write_bytes(text.encode())
    with pytest.raises(PySparkException, match="two-space"):
        src.scan_conversations_json(spark, str(path), layout="indented").collect()
    path.write_text(json.dumps(records, indent=2))
    assert src.scan_conversations_json(spark, str(path), layout="indented").count() == 5


def test_reader_follows_the_suffix(spark, tmp_path):
    folder = tmp_path / "ultra"
    folder.mkdir()
    (folder / "x.jsonl").write_text('{"id": "a", "conversations": []}\n')
    assert src.load_conversations(spark, str(folder / "x.jsonl")).count() == 1


def test_containers_may_spell_turns_differently(spark):
    rows = [([("q",)], None), ([], [("user", "hi")])]
    df = spark.createDataFrame(
        rows, "conversations array<struct<value:string>>, items array<struct<role:string,content:string>>"
    )
    got = [[tuple(t) for t in r["conversations"]] for r in src.coalesce_turn_fields(df).collect()]
    assert got == [[(None, "q")], [("user", "hi")]]


def test_vocabulary_is_built_once_per_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for n, want in ((10, 1), (10, 1), (20, 2), (10, 1)):
        assert sinks.load_or_build_vocab(spark, str(tmp_path), build, n=n).count() == want
    assert len(calls) == 2


def test_union_fills_absent_columns(spark):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int")
    rows = src.union_all_files([one, two, one]).collect()
    assert sorted((r["a"], r["b"]) for r in rows if r["b"] is None) == [(1, None), (1, None)]
    counts = {r["stage"]: r["records"] for r in sinks.record_counts(x=one, y=two).collect()}
    assert counts == {"x": 1, "y": 1}
