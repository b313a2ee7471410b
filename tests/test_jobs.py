"""Whole jobs over files, and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom import session
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators import records
from dialoom.operators.vocabulary import text_token_frequency
from dialoom.plans import jobs
from dialoom.sources import conversations as src
from dialoom.streaming import jobs as streams
from tests.conftest import as_dict

H, G = "human", "gpt"


def _corpus(path, n=40):
    lines = [
        json.dumps({"id": f"c_{i}", "conversations": [
            {"from": H, "value": f"q{i}"}, {"from": G, "value": "" if i % 4 == 0 else "a"},
        ] + ([{"from": H, "value": "tail"}] if i % 3 == 0 else [])})
        for i in range(n)
    ]
    path.write_text("\n".join(lines))


def test_clean_and_split(spark, tmp_path):
    source, target = tmp_path / "x.jsonl", tmp_path / "out"
    _corpus(source)
    counts = jobs.clean_and_split(spark, str(source), str(target))
    assert {r["split"]: r["records"] for r in counts.collect()} == {"train": 38, "test": 2}
    cleaned = as_dict(records.clean_conversations(src.load_conversations(spark, str(source))))
    assert as_dict(src.scan_conversations_jsonl(spark, str(target))) == cleaned
    whole = tmp_path / "whole"
    counts = jobs.clean_and_split(spark, str(source), str(whole), full=True)
    assert [(r["stage"], r["records"]) for r in counts.collect()] == [("cleaned", 40)]
    assert as_dict(src.scan_conversations_jsonl(spark, str(whole))) == cleaned


def test_counts_are_taken_while_writing(spark, tmp_path):
    from dialoom.sources import sinks

    counts = sinks.StageCounts(spark)
    df = counts.watch(spark.range(100), loaded=F.lit(True))
    kept = counts.watch(df.filter("id % 10 < 7"), kept=F.lit(True), even=F.col("id") % 2 == 0)
    kept.write.parquet(str(tmp_path / "kept"))
    assert [tuple(r) for r in counts.table().collect()] == [("loaded", 100), ("kept", 70), ("even", 40)]


def test_clean_and_split_keeps_every_value(spark, tmp_path):
    """Keys whose types differ from record to record, with a schema that nobody has to find."""
    source, target = tmp_path / "x.jsonl", tmp_path / "out"
    rows = [
        {"id": f"c_{i}", "meta": [i, str(i), {"n": i}, None][i % 4], "conversations": [
            {"from": H, "value": "q", "score": i / 4}, {"from": G, "value": "a"}]} for i in range(40)
    ]
    source.write_text("\n".join(json.dumps(dict(r, conversations=r["conversations"] + [{"from": H, "value": "z"}])) for r in rows))
    counts = jobs.clean_and_split(spark, str(source), str(target))
    assert {r["split"]: r["records"] for r in counts.collect()} == {"train": 38, "test": 2}
    written = [json.loads(r["value"]) for r in spark.read.text(str(target)).collect()]
    assert sorted(written, key=lambda r: int(r["id"][2:])) == rows


def test_clean_and_split_without_ids(spark, tmp_path):
    source, target = tmp_path / "x.jsonl", tmp_path / "out"
    turns = lambda i: [{"from": H, "value": f"q{i}"}, {"from": G, "value": "a"}, {"from": H, "value": "z"}]
    source.write_text("\n".join(json.dumps({"conversations": turns(i)}) for i in range(40)))
    counts = jobs.clean_and_split(spark, str(source), str(target))
    assert {r["split"]: r["records"] for r in counts.collect()} == {"train": 38, "test": 2}
    written = src.scan_conversations_jsonl(spark, str(target), None)
    assert sorted(r["conversations"][0]["value"] for r in written.collect()) == sorted(f"q{i}" for i in range(40))
    assert {len(r["conversations"]) for r in written.collect()} == {2}


def test_sample_corpus(spark, tmp_path):
    source, target = tmp_path / "x.jsonl", tmp_path / "sample"
    _corpus(source, 400)
    jobs.sample_corpus(spark, str(source), str(target), p=0.2)
    assert 40 < src.scan_conversations_jsonl(spark, str(target)).count() < 120


def test_indexed_corpus(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    rows = [{"messages": [{"role": "user", "content": "q"}, {"role": "system", "content": "s"}]}]
    path.write_text("\n".join(map(json.dumps, rows)))
    from dialoom.schema import LOOSE_CONVERSATION

    loose = src.scan_conversations_jsonl(spark, str(path), LOOSE_CONVERSATION)
    made = jobs.indexed_corpus(loose.withColumn("line", F.lit(5).cast("bigint")), "line")
    assert as_dict(made) == {"regenerated_0": [(H, "q")]}


def test_clean_stream_equals_batch(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    paths = [str(tmp_path / n) for n in ("out", "progress")]
    for i in range(3):
        _corpus(arriving / f"{i}.json", 10 * (i + 1))
        streams.stream_clean(spark, str(arriving), *paths, max_files=1).awaitTermination()
    streams.stream_clean(spark, str(arriving), *paths).awaitTermination()
    stream = src.scan_conversations_jsonl(spark, paths[0])
    batch = records.clean_conversations(src.scan_conversations_jsonl(spark, str(arriving)))
    assert stream.count() == 60
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()


def test_frequency_stream_equals_batch(spark, tmp_path):
    tokenizer, arriving = RegexTokenizer(), str(tmp_path / "in")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for i in range(2):
        texts = spark.createDataFrame(
            [(d, f"a b{d} c{i} <x> a") for d in range(20)], "doc_id bigint, text string"
        )
        texts.repartition(3).write.mode("append").parquet(arriving)
        streams.stream_token_frequency(
            spark, arriving, out, progress, tokenizer, max_files=2
        ).awaitTermination()
    stream = streams.latest_frequency(spark, out)
    batch = text_token_frequency(spark.read.parquet(arriving), tokenizer)
    assert stream.select("token_id", "freq").exceptAll(batch).isEmpty()
    assert stream.count() == batch.count()


def test_own_folder_is_refused_where_executors_cannot_read_it():
    assert session.own_folder("local[8]", "file:/here/warehouse/").startswith("file:/here/warehouse/_dialoom-")
    assert session.own_folder("yarn", "hdfs://name/warehouse").startswith("hdfs://name/warehouse/_dialoom-")
    for warehouse in ("file:/here/warehouse", "/here/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.own_folder("spark://host:7077", warehouse)


def test_shared_folder_is_that_of_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark).startswith(("file:", configured))
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_broadcast_needs_a_bound(spark):
    big, side = spark.range(10), spark.range(3)

    def strategy(bound):
        joined = big.join(session.broadcast_if_bounded(side, bound), "id")
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in strategy(3)
    assert "broadcast" not in strategy(None)
    assert "broadcast" not in strategy(session.BROADCAST_ROWS + 1)


def test_other_keys_survive_cleaning(spark, tmp_path):
    source, target = tmp_path / "x.jsonl", tmp_path / "out"
    source.write_text(json.dumps({
        "id": "a", "lang": "en", "conversations": [{"from": H, "value": "q", "weight": 1}] * 2,
    }))
    jobs.clean_and_split(spark, str(source), str(target), full=True)
    line = spark.read.text(str(target)).collect()[0][0]
    assert json.loads(line) == {
        "id": "a", "lang": "en", "conversations": [{"from": H, "value": "q", "weight": 1}],
    }


def test_vocabulary_follows_the_order_of_lines(spark, tmp_path):
    """Equal counts go by first occurrence in the files: as reading them in order gives."""
    from dialoom.functions.text import LLAMA
    from dialoom.operators.features import featurize

    rows = [
        {"id": f"c_{i}", "conversations": [
            {"from": H, "value": "q"}, {"from": G, "value": f"w{(i * 37) % 101} x{(i * 53) % 103} y{i % 3}"},
        ]} for i in range(90)
    ]
    source = tmp_path / "in"
    source.mkdir()
    for name, part in (("b.jsonl", rows[30:]), ("a.jsonl", rows[:30])):
        (source / name).write_text("\n".join(map(json.dumps, part)))
    tokenizer = RegexTokenizer()
    jobs.vocabulary_corpus(spark, str(source), str(tmp_path / "out"), LLAMA, tokenizer, 40, fmt="jsonl")
    numbered = spark.createDataFrame([(i, r["id"], r["conversations"]) for i, r in enumerate(rows)],
                                     "idx long, id string, conversations array<struct<`from`:string,value:string>>")
    counts, first = {}, {}
    for r in featurize(numbered, LLAMA, tokenizer, keep=("idx",)).orderBy("idx").collect():
        for pos, (token, mask) in enumerate(zip(r["input_ids"], r["loss_mask"])):
            if mask:
                counts[token] = counts.get(token, 0) + 1
                first.setdefault(token, (r["idx"], pos))
    want = sorted(counts, key=lambda t: (-counts[t], first[t]))[:40]
    maps = spark.read.parquet(str(tmp_path / "out/maps"))
    assert {r["token_id"] for r in maps.collect()} == set(want)
    assert len(set(counts.values())) < 10


def test_regenerated_records_keep_their_places(spark, tmp_path):
    from dialoom.operators.regenerate import RetryPolicy

    rows = [{"conversations": [{"from": H, "value": f"q{i}"}, {"from": G, "value": "a"}]} for i in range(12)]
    source = tmp_path / "x.json"
    source.write_text(json.dumps(rows, indent=1))
    jobs.regenerate_dataset(
        spark, str(source), str(tmp_path / "saved"), lambda prompt: prompt[7:9], batch_save=3,
        start_index=4, end_index=9, policy=RetryPolicy(min_interval=0.0),
    )
    saved = spark.read.json(str(tmp_path / "saved"))
    assert {(r["id"], r["conversations"][1]["value"]) for r in saved.collect()} == {
        (f"regenerated_{i}", f"q{i}") for i in range(4, 9)
    }


def test_command_line(spark, tmp_path, capsys):
    from dialoom.__main__ import parser, run

    source = tmp_path / "x.jsonl"
    _corpus(source)
    for argv in (
        ["clean", str(source), str(tmp_path / "clean"), "--ratio", "0.5"],
        ["sample", str(source), str(tmp_path / "sample"), "-p", "0.9"],
    ):
        run(spark, parser().parse_args(argv))
    assert "train" in capsys.readouterr().out
    assert src.scan_conversations_jsonl(spark, str(tmp_path / "clean")).count() == 40
    lines = set(source.read_text().split("\n"))
    sampled = {r[0] for r in spark.read.text(str(tmp_path / "sample")).collect()}
    assert sampled < lines and len(sampled) > 20
