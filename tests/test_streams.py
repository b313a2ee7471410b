"""Streams whose state reaches over files and restarts."""

import json

from dialoom.functions.text import LLAMA
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators import features
from dialoom.operators.vocabulary import token_frequency
from dialoom.sources import conversations as src
from dialoom.streaming import conversations as closing
from dialoom.streaming import jobs as streams
from tests.conftest import as_dict

H, G = "human", "gpt"


def _add(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"id": i, "pos": p, "from": f, "value": v, "ts": f"2024-01-01T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z"})
             for i, p, f, v, t in rows]
    (folder / name).write_text("\n".join(lines))


def _run(spark, tmp_path, **options):
    paths = [str(tmp_path / n) for n in ("in", "out", "progress")]
    streams_done = closing.stream_conversations(spark, *paths, pause_seconds=60, lateness="10 seconds", max_files=1, **options)
    streams_done.awaitTermination()
    return as_dict(src.scan_conversations_jsonl(spark, str(tmp_path / "out")))


def test_conversations_close_after_a_pause(spark, tmp_path):
    """Turns in several files and runs, out of order; what is closed is clean and comes once."""
    arriving = tmp_path / "in"
    _add(arriving, "1", [("a", 0, H, "q", 0), ("b", 1, G, "r", 5), (None, 0, H, "n", 1)])
    assert _run(spark, tmp_path) == {}
    _add(arriving, "2", [("b", 0, H, "p", 4), ("a", 1, "system", "s", 20), ("a", 2, G, "r", 21), (None, 1, G, "m", 30)])
    _add(arriving, "3", [("a", 3, H, "open question", 40)])
    assert _run(spark, tmp_path) == {}
    _add(arriving, "4", [("c", 0, H, "x", 200), ("c", 1, G, "", 201)])
    want = {"a": [(H, "q"), (G, "r")], "b": [(H, "p"), (G, "r")], None: [(H, "n"), (G, "m")]}
    assert _run(spark, tmp_path) == want
    _add(arriving, "5", [("a", 0, H, "again", 400), ("d", 0, H, "late", 3)])
    got = _run(spark, tmp_path)
    assert got == want | {"c": []}  # both of its turns were an empty exchange
    _add(arriving, "6", [("e", 0, H, "end", 4000)])
    rows = src.scan_conversations_jsonl(spark, str(tmp_path / "out"))
    _run(spark, tmp_path)
    assert sorted(r["id"] or "" for r in src.scan_conversations_jsonl(spark, str(tmp_path / "out")).collect()) == ["", "a", "a", "b", "c"]
    assert "d" not in {r["id"] for r in rows.collect()}


def test_turns_over_batches_equal_the_batch_job(spark, tmp_path):
    rows = [
        (f"c_{i}", p, H if p % 2 == 0 else G, "" if (i + p) % 5 == 0 else f"v{i}{p}", p * 7 + i % 3)
        for i in range(25) for p in range(1 + i % 6)
    ]
    for n in range(4):
        _add(tmp_path / "in", f"{n}", [r for r in rows if r[4] // 10 == n])
        _run(spark, tmp_path)
    _add(tmp_path / "in", "z", [("end", 0, "system", "", 80_000)])
    got = _run(spark, tmp_path)
    turns = spark.createDataFrame([r[:4] for r in rows], "id string, pos bigint, `from` string, value string")
    assert got == as_dict(features.cleaned_records(turns))


def test_supervised_counts_equal_the_batch_after_a_restart(spark, tmp_path):
    tokenizer, arriving = RegexTokenizer(), tmp_path / "in"
    arriving.mkdir()
    paths = [str(tmp_path / n) for n in ("in", "out", "progress")]
    schema = "id string, conversations array<struct<`from`:string,value:string>>, n bigint"
    every = []
    for i in (2, 0, 1):  # the first records come last
        rows = [
            {"id": f"{i}_{k}", "n": i * 100 + k, "conversations": [
                {"from": H, "value": f"ask {k % 7}"}, {"from": G, "value": f"say {k % 5} w{i} and {k % 3}"}]}
            for k in range(30)
        ]
        (arriving / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        every += rows
        streams.stream_supervised_frequency(
            spark, *paths, LLAMA, tokenizer, schema, seq="n", max_files=1
        ).awaitTermination()
    got = streams.latest_frequency(spark, paths[1])
    batch = spark.createDataFrame([(r["id"], r["conversations"], r["n"]) for r in every], schema)
    want = token_frequency(features.featurize(batch, LLAMA, tokenizer, keep=("n",)), "n")
    key = lambda df: sorted((r["token_id"], r["freq"], tuple(r["first_seen"])) for r in df.collect())
    assert key(got) == key(want) and got.count() > 5
