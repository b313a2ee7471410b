import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialoom.operators import records
from tests.conftest import as_dict

H, G = "human", "gpt"


def test_trailing_human_is_dropped_once(conv):
    df = conv({"a": [(H, "1"), (H, "2")], "b": [(H, "1"), (G, "2")], "c": [], "d": None})
    assert as_dict(records.drop_trailing_human(df)) == {
        "a": [(H, "1")], "b": [(H, "1"), (G, "2")], "c": [], "d": [],
    }


def test_trailing_empty_reply(conv):
    df = conv(
        {
            "null": [(H, "q"), (G, None)],
            "empty": [(H, "q"), (G, "")],
            "space": [(H, "q"), (G, " ")],
            "twice": [(H, "q"), (G, ""), (H, "q"), (G, "")],
            "no question": [(G, "x"), (G, "")],
            "alone": [(G, "")],
            "other role": [("system", "s"), (G, "")],
        }
    )
    assert as_dict(records.drop_trailing_empty_reply(df)) == {
        "null": [], "empty": [], "space": [(H, "q"), (G, " ")], "twice": [(H, "q"), (G, "")],
        "no question": [(G, "x"), (G, "")], "alone": [(G, "")],
        "other role": [("system", "s"), (G, "")],
    }


def test_cleaning_uncovers_an_empty_reply_and_keeps_the_record(conv):
    df = conv({"a": [(H, "q"), (G, ""), (H, "more")], "b": [(H, "q")]})
    assert as_dict(records.clean_conversations(df)) == {"a": [], "b": []}
    assert records.skip_empty(records.clean_conversations(df)).count() == 0


def test_other_columns_survive_cleaning(conv):
    df = conv({"a": [(H, "q")]}).withColumn("extra", F.lit(7))
    assert records.clean_conversations(df).select("extra").collect()[0][0] == 7


def test_leading_turn(conv):
    df = conv({"a": [(G, "x"), (H, "q")], "b": [(G, "x")], "c": [(None, "x"), (H, "q")],
               "d": [(H, "q")]})
    assert as_dict(records.drop_leading_non_human(df)) == {
        "a": [(H, "q")], "b": [], "c": [(H, "q")], "d": [(H, "q")],
    }


def test_alternation(conv):
    df = conv({"ok": [(H, "1"), (G, "2"), (H, "3")], "bad": [(H, "1"), (H, "2"), (G, "3")]})
    assert set(as_dict(records.check_alternation(df, "drop"))) == {"ok"}
    marked = records.check_alternation(df, "quarantine")
    assert {r["id"]: r["alternates"] for r in marked.collect()} == {"ok": True, "bad": False}
    with pytest.raises(PySparkException, match="out of order"):
        records.check_alternation(df).collect()
    with pytest.raises(ValueError):
        records.check_alternation(df, "ignore")


def test_dialogue_roles(conv):
    df = conv({"a": [("system", "s"), ("user", "q"), ("assistant", "r"), ("tool", "t"), (H, "u")]})
    assert as_dict(records.keep_dialogue_roles(df)) == {"a": [(H, "q"), (G, "r"), (H, "u")]}


def test_messages(conv):
    df = conv({"a": [(H, "q"), (G, "r")]})
    made = records.to_messages(df, "model", "be brief").collect()[0]["messages"]
    assert [(m["role"], m["content"]) for m in made] == [
        ("system", "be brief"), ("user", "q"), ("model", "r"),
    ]
    with pytest.raises(PySparkException, match="unknown role"):
        records.to_messages(conv({"a": [("tool", "q")]}), "model").collect()


def test_trainable_turns_is_the_three_steps(conv):
    df = conv({"a": [(G, "x"), (H, "q"), (G, "r")], "b": [(G, "x")], "c": [], "d": [(H, "q")]})
    assert as_dict(records.trainable_turns(df)) == {"a": [(H, "q"), (G, "r")], "d": [(H, "q")]}
    with pytest.raises(PySparkException, match="out of order"):
        records.trainable_turns(conv({"a": [(H, "q"), (H, "q")]})).collect()


def test_prompts(conv):
    df = conv({"a": [(H, "q"), (G, "r"), (H, None), (G, "s")]})
    assert [(r["pos"], r["prompt"]) for r in records.build_prompts(df).orderBy("pos").collect()] == [
        (1, "Human: q\n\nAssistant:"),
        (3, "Human: q\n\nAssistant: r\n\nHuman: \n\nAssistant:"),
    ]


def test_cleaning_inside_whole_records(spark):
    """Every key and every other field of a turn keeps its value; mixed types do not matter."""
    import json

    turn = lambda f, v, **more: {"from": f, "value": v, **more}
    kept = [
        {"id": "a", "meta": {"x": [1, None, "é"], "y": 1.25}, "conversations": [turn(H, "q", w=1), turn(G, "a", tool={"n": 2})]},
        {"id": 7, "meta": "text", "conversations": [turn(H, "q"), turn(G, [{"type": "text", "text": "body"}])]},
        {"id": None, "meta": 10**25, "conversations": []}, {"k": True}, {"conversations": None, "k": "c"}, {"conversations": "odd"},
        {"conversations": [turn("system", "s")]}, {"conversations": [turn(G, "")]}, {"conversations": ["odd", 5]},
    ]
    more = [[turn(H, "z")], [], [], None, None, None, [turn(H, "tail", x=1)], [turn(H, "tail")], []]
    told = [dict(r, conversations=r["conversations"] + m) if m else r for r, m in zip(kept, more)]
    empty = [{"n": i, "conversations": [turn(H, "q"), turn(G, v), turn(H, "q2"), {"from": G} if v == 5 else turn(G, v)]}
             for i, v in enumerate([None, "", 0, False, [], {}, 5])]
    shorter = [dict(r, conversations=r["conversations"][:2]) for r in empty]
    lines = spark.createDataFrame([(json.dumps(r),) for r in told + empty], "value string")
    made = records.clean_variant(lines.select(F.parse_json("value").alias("record")))
    got = [json.loads(r[0]) for r in made.select(F.to_json("record")).collect()]
    assert got == kept + shorter


def test_cleaning_inside_records_equals_the_typed_one(spark, conv):
    import random

    rng = random.Random(8)
    data = {
        f"c_{i}": [(rng.choice([H, G, "system"]), rng.choice(["", "x", None])) for _ in range(rng.randint(0, 6))]
        for i in range(150)
    }
    typed = conv(data)
    text = F.to_json(F.struct("id", "conversations"), {"ignoreNullFields": "false"})
    made = records.clean_variant(typed.select(F.parse_json(text).alias("record")))
    fields = "struct<id:string,conversations:array<struct<`from`:string,value:string>>>"
    flat = made.select(F.variant_get("record", "$", fields).alias("r")).select("r.*")
    assert as_dict(flat) == as_dict(records.clean_conversations(typed))
