"""Turn-table operators against the record operators and plain Python."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialoom.functions.text import LLAMA
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators import features, records
from dialoom.operators import turn_table as tt
from tests.conftest import as_dict

H, G = "human", "gpt"


def _random_records(n, longest, seed):
    rng = random.Random(seed)
    return {
        f"c_{i}": [
            (rng.choice([H, H, G, G, "system"]), rng.choice(["", "x", "some text"]))
            for _ in range(rng.randint(1, longest))
        ]
        for i in range(n)
    }


def _by_id(df, order="ord"):
    out = {}
    for r in df.orderBy("id", order).collect():
        out.setdefault(r["id"], []).append((r["from"], r["value"]))
    return out


@pytest.fixture(params=[3, 4096])
def chunk(request, monkeypatch):
    """Chunks of three turns make every conversation a long one."""
    monkeypatch.setattr(tt, "CHUNK", request.param)
    return request.param


@pytest.mark.parametrize(
    "step", ["drop_trailing_human", "drop_trailing_empty_reply", "clean_conversations",
             "drop_leading_non_human"]
)
def test_same_as_on_records(turns, conv, chunk, step):
    data = _random_records(120, 9, 5)
    spoken = tt.keep_dialogue_roles(turns(data))
    flat = tt.pick(spoken, getattr(tt, step)(tt.outline(spoken)))
    assert _by_id(getattr(tt, step)(tt.numbered(spoken))) == _by_id(flat)
    nested = getattr(records, step)(records.keep_dialogue_roles(conv(data)))
    assert _by_id(flat) == {k: v for k, v in as_dict(nested).items() if v}


def test_sparse_places_at_the_end(turns):
    """The last three turns lie in three chunks of places."""
    data = turns({"a": [(H, "q"), (G, "a"), (H, "q"), (G, ""), (H, "z")]})
    sparse = data.withColumn("pos", F.col("pos") * 1_000_000_000)
    assert _by_id(tt.clean_conversations(tt.numbered(sparse))) == {"a": [(H, "q"), (G, "a")]}


def test_numbers_are_dense(turns, chunk):
    data = _random_records(50, 20, 6)
    numbered = tt.number_turns(tt.keep_dialogue_roles(turns(data)))
    ranks = {}
    for r in numbered.orderBy("id", "pos").collect():
        ranks.setdefault(r["id"], []).append(r["ord"])
    assert ranks and all(v == list(range(len(v))) for v in ranks.values())


def test_alternation_modes(turns):
    data = {"ok": [(H, "1"), (G, "2")], "bad": [(H, "1"), (H, "2")]}
    numbered = tt.outline(turns(data))
    assert {r["id"] for r in tt.check_alternation(numbered, "drop").collect()} == {"ok"}
    marks = tt.check_alternation(numbered, "quarantine").select("id", "alternates").distinct()
    assert {r["id"]: r["alternates"] for r in marks.collect()} == {"ok": True, "bad": False}
    with pytest.raises(PySparkException, match="out of order"):
        tt.check_alternation(numbered).collect()


def test_unknown_role_modes(turns):
    data = turns({"a": [("tool", "x"), (H, "q")]})
    assert tt.map_roles(data, "model", "drop").count() == 1
    assert tt.map_roles(data, "model", "quarantine").filter("role IS NULL").count() == 1
    with pytest.raises(PySparkException, match="unknown role"):
        tt.map_roles(data, "model").collect()


def test_collect_and_explode_keep_long_conversations_whole(turns):
    data = {"long": [(H, str(i)) for i in range(5000)], "short": [(H, "x")]}
    nested = tt.collect_turns(turns(data))
    assert nested.count() == 2
    assert _by_id(tt.explode_turns(nested), "pos") == data


def test_null_ids_are_kept(spark):
    rows = [(None, p, H if p % 2 == 0 else G, "x") for p in range(5000)] + [("a", 0, G, "y"), ("a", 1, H, "z")]
    turns_ = spark.createDataFrame(rows, "id string, pos bigint, `from` string, value string")
    outline = tt.outline(turns_)
    assert tt.pick(turns_, outline).count() == 5002
    assert outline.filter("id IS NULL").agg({"ord": "max"}).first()[0] == 4999
    assert tt.pick(turns_, tt.clean_conversations(outline)).count() == 5001
    assert tt.drop_leading_non_human(outline).count() == 5001
    marked = tt.check_alternation(outline, "quarantine")
    assert {(r["id"], r["alternates"]) for r in marked.collect()} == {(None, True), ("a", False)}
    assert tt.check_alternation(outline, "drop").count() == 5000


def test_explode_keeps_records_without_turns(conv):
    rows = tt.explode_turns(conv({"a": [], "b": None, "c": [(H, "x")]})).collect()
    assert sorted((r["id"], r["pos"]) for r in rows if r["pos"] is None) == [("a", None), ("b", None)]
    assert len(rows) == 3


def _alternating(n, end_human=False):
    turns_ = [(H if i % 2 == 0 else G, f"word{i} and more") for i in range(n)]
    return turns_ + ([(H, "left over")] if end_human else [])


def test_a_long_conversation_is_rendered_and_masked_whole(turns):
    data = {f"c_{n}": _alternating(n, n % 4 == 0) for n in (2, 4, 60, 5000)}
    made = features.trainable_records(turns(data))
    texts = {r["id"]: r["text"] for r in features.chat_texts(made, LLAMA).collect()}
    assert texts["c_5000"].count("<|eot_id|>") == 5001
    assert "word4999 and more" in texts["c_5000"] and "left over" not in texts["c_5000"]
    rows = {r["id"]: r for r in features.featurize(made, LLAMA, RegexTokenizer()).collect()}
    assert all(len(r["input_ids"]) == len(r["loss_mask"]) for r in rows.values())
    assert len(rows["c_5000"]["input_ids"]) > 20_000 and sum(rows["c_5000"]["loss_mask"][-5000:]) > 0


def test_cleaned_records_of_long_conversations(turns):
    data = {f"c_{n}": _alternating(n, True) for n in (2, 4, 60, 5000)}
    got = _by_id(tt.explode_turns(features.cleaned_records(turns(data))), "pos")
    assert got == {f"c_{n}": _alternating(n) for n in (2, 4, 60, 5000)}


def test_inject_system(turns):
    out = tt.inject_system(tt.number_turns(turns({"a": [(H, "q"), (G, "r")]})), "s")
    assert _by_id(out) == {"a": [("system", "s"), (H, "q"), (G, "r")]}
