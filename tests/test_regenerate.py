import hashlib
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import dialoom
from dialoom.operators import regenerate as gen
from dialoom.plans import jobs
from dialoom.sources import conversations as src
from dialoom.sources import sinks
from tests.conftest import as_dict

H, G = "human", "gpt"
QUICK = gen.RetryPolicy(min_interval=0, first_wait=0, wait_step=0, max_attempts=3)

for module in (dialoom, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


def reply(prompt):
    return hashlib.md5(prompt.encode()).hexdigest()


def failing(errors):
    """A service that raises the given errors in turn and then answers."""
    left = list(errors)

    def call(prompt):
        if left:
            raise left.pop(0)
        return "fine"

    return call


def test_retry():
    http = gen.GenerationError
    assert gen.call_with_retry(failing([http(503), http(404)]), "p", QUICK) == ("fine", None, 3)
    value, error, attempts = gen.call_with_retry(failing([http(503)] * 9), "p", QUICK)
    assert (value, attempts) == ("", 3) and "503" in error
    assert gen.call_with_retry(failing([ValueError("pipe")]), "p", QUICK) == ("", "pipe", 1)
    assert gen.call_with_retry(failing([http(302)]), "p", QUICK)[2] == 1
    with pytest.raises(ValueError):
        gen.call_with_retry(failing([ValueError("x")]), "p", gen.RetryPolicy(0, on_error="fail"))
    quiet = gen.RetryPolicy(0, 0, 0, max_attempts=1, on_error="null")
    assert gen.call_with_retry(failing([http(500)]), "p", quiet)[0] is None


def test_status_on_a_response_counts():
    class Answer:
        status_code = 429

    class Refused(Exception):
        response = Answer()

    assert gen.call_with_retry(failing([Refused()]), "p", QUICK) == ("fine", None, 2)


def test_waits_grow_to_a_limit(monkeypatch):
    waits = []
    monkeypatch.setattr(gen.time, "sleep", waits.append)
    policy = gen.RetryPolicy(min_interval=0, max_attempts=14)
    gen.call_with_retry(failing([gen.GenerationError(500)] * 20), "p", policy)
    assert waits == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10, 10]


def test_later_prompts_hold_new_replies(spark, conv):
    data = {"a": [(H, "q"), (G, "old"), (H, "r"), (G, "old"), ("system", "s")], "b": [], "c": None}
    df = conv(data).withColumn("idx", F.monotonically_increasing_id())
    made = gen.regenerate_replies(df, reply, QUICK, partitions=3)
    first = reply("Human: q\n\nAssistant:")
    second = reply(f"Human: q\n\nAssistant: {first}\n\nHuman: r\n\nAssistant:")
    assert as_dict(made) == {"a": [(H, "q"), (G, first), (H, "r"), (G, second)], "b": [], "c": []}


def test_failures_are_recorded(spark, conv):
    def broken(prompt):
        raise ValueError("no route")

    df = conv({"a": [(H, "q"), (G, "x")]}).withColumn("idx", F.lit(0).cast("bigint"))
    row = gen.regenerate_replies(df, broken, QUICK).collect()[0]
    assert (row["conversations"][1]["value"], row["attempts"], row["errors"]) == ("", [1], ["no route"])


def test_batches_resume_and_merge(spark, tmp_path, conv):
    data = {f"c_{i}": [(H, f"q{i}"), (G, "old")] for i in range(17)}
    df = conv(data).withColumn("idx", F.substring_index("id", "_", -1).cast("bigint"))
    saved, merged = str(tmp_path / "saved"), str(tmp_path / "merged")
    calls = spark.sparkContext.accumulator(0)

    def counted(prompt):
        calls.add(1)
        return reply(prompt)

    options = dict(batch_save=3, start_index=2, policy=QUICK, commits=3)
    jobs.regenerate_corpus(spark, df, saved, counted, end_index=9, **options)
    assert calls.value == 7
    jobs.regenerate_corpus(spark, df, saved, counted, end_index=17, **options)
    assert calls.value == 15
    jobs.merge_corpus(spark, saved, merged)
    assert as_dict(src.scan_conversations_jsonl(spark, merged)) == {
        f"c_{i}": [(H, f"q{i}"), (G, reply(f"Human: q{i}\n\nAssistant:"))] for i in range(2, 17)
    }


def test_failed_replies_are_asked_for_again(spark, tmp_path, conv):
    """The service is down in the first run and well in the second."""
    data = {f"c_{i}": [(H, f"q{i}"), (G, "old")] for i in range(6)}
    df = conv(data).withColumn("idx", F.substring_index("id", "_", -1).cast("bigint"))
    saved, merged = str(tmp_path / "saved"), str(tmp_path / "merged")

    def down(prompt):
        raise ValueError("no route")

    options = dict(batch_save=2, start_index=0, end_index=6, policy=QUICK)
    jobs.regenerate_corpus(spark, df, saved, down, **options)
    jobs.regenerate_corpus(spark, df, saved, reply, **options)
    jobs.regenerate_corpus(spark, df, saved, down, **options)  # nothing is left to ask
    jobs.merge_corpus(spark, saved, merged)
    assert as_dict(src.scan_conversations_jsonl(spark, merged)) == {
        f"c_{i}": [(H, f"q{i}"), (G, reply(f"Human: q{i}\n\nAssistant:"))] for i in range(6)
    }


def test_a_grown_range_reads_back_whole(spark, tmp_path, conv):
    data = {f"c_{i}": [(H, f"q{i}"), (G, "old")] for i in range(40)}
    df = conv(data).withColumn("idx", F.substring_index("id", "_", -1).cast("bigint"))
    saved = str(tmp_path / "saved")
    for end in (20, 40):
        jobs.regenerate_corpus(spark, df, saved, reply, 1, 0, end, policy=QUICK, commits=2)
    assert sorted(r["idx"] for r in sinks.scan_batches(spark, saved).collect()) == list(range(40))


def test_datasets_without_ids(spark, tmp_path):
    rows = [([(H, f"q{i}"), (G, "old")],) for i in range(5)] + [([(H, "q0"), (G, "old")],)]
    df = spark.createDataFrame(rows, "messages array<struct<`from`:string,value:string>>")
    df.write.parquet(str(tmp_path / "chats"))
    made = jobs.indexed_corpus(src.load_conversations(spark, str(tmp_path / "chats"), "parquet"))
    got = made.collect()
    assert sorted(r["idx"] for r in got) == list(range(6))
    assert all(r["id"] == f"regenerated_{r['idx']}" and len(r["conversations"]) == 2 for r in got)


def test_map_batched(spark):
    def keep_even(pdf):
        return pdf[pdf["id"] % 2 == 0].assign(double=lambda d: d["id"] * 2)[["double"]]

    rows = gen.map_batched(spark.range(10), keep_even, "double bigint").collect()
    assert sorted(r["double"] for r in rows) == [0, 4, 8, 12, 16]


def test_dataset_to_merged_corpus(spark, tmp_path):
    """From loosely spelled JSONL without any order column."""
    import json

    source = tmp_path / "x.jsonl"
    rows = [
        {"id": f"c_{i}", "messages": [{"role": "user", "content": f"q{i}"},
                                      {"role": "assistant", "content": "old"}]}
        for i in range(9)
    ]
    source.write_text("\n".join(map(json.dumps, rows)))
    saved, merged = str(tmp_path / "saved"), str(tmp_path / "merged")
    jobs.regenerate_dataset(spark, str(source), saved, reply, batch_save=4, policy=QUICK)
    jobs.merge_corpus(spark, saved, merged)
    assert as_dict(src.scan_conversations_jsonl(spark, merged)) == {
        f"c_{i}": [(H, f"q{i}"), (G, reply(f"Human: q{i}\n\nAssistant:"))] for i in range(9)
    }


def test_chat_service(monkeypatch):
    import io
    import json
    import urllib.error

    from dialoom.sources import service

    seen = []

    def answer(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.headers, timeout))
        if len(seen) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", None, None)
        return io.BytesIO(b'{"choices": [{"message": {"content": "hello"}}]}')

    monkeypatch.setattr(service.urllib.request, "urlopen", answer)
    chat = service.ChatService("http://host/v1/", "m", api_key="k")
    assert gen.call_with_retry(chat, "p", QUICK) == ("hello", None, 2)
    url, body, headers, timeout = seen[1]
    assert url == "http://host/v1/chat/completions" and timeout == 60
    assert body["messages"] == [{"role": "user", "content": "p"}]
    assert (body["temperature"], body["max_tokens"]) == (0.7, 2048)
    assert headers["Authorization"] == "Bearer k"


def test_one_rate_for_all_tasks(spark, conv, tmp_path):
    """Calls of tasks that run side by side keep the interval of the job, as a log of them shows."""
    import time

    folder = str(tmp_path)

    def noted(prompt):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(repr(time.time()))
        return "a"

    data = conv({f"c_{i}": [(H, "q"), (G, "x"), (H, "q"), (G, "x")] for i in range(24)})
    numbered = data.withColumn("idx", F.substring_index("id", "_", -1).cast("bigint"))
    policy = gen.RetryPolicy(min_interval=0.05)
    assert gen.regenerate_replies(numbered, noted, policy, partitions=8, threads=4).count() == 24
    at = sorted(float((tmp_path / n).read_text()) for n in __import__("os").listdir(folder))
    assert len(at) == 48
    # Any second has at most as many calls as the interval allows, and one more for each task.
    for i, start in enumerate(at):
        assert sum(start <= t < start + 1 for t in at[i:]) <= 20 + 8
