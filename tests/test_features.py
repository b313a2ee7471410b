"""Masks, padding and tokens against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dialoom.functions import masks
from dialoom.functions.text import GEMMA, LLAMA, render_chat, stripped, word_count
from dialoom.functions.tokens import PATTERN, BatchTokenizer, RegexTokenizer
from dialoom.operators import features, records, sampling
from dialoom.schema import SYSTEM_PROMPT

H, G = "human", "gpt"
TOKENIZER = RegexTokenizer()


def words(text):
    return re.findall(PATTERN, text)


def unsupervised(round_lengths, instruction_lengths):
    """Ranges of positions that get no supervision, from the lengths of the usable rounds."""
    ranges, cur = [(0, 1)], 1
    for i, (length, instruction) in enumerate(zip(round_lengths, instruction_lengths)):
        ranges.append(
            (cur, cur + instruction - 2) if i == 0 else (cur - 3, cur + instruction + 1)
        )
        cur += length + (3 if i else 0)
    return ranges + [(cur, 10**9)]


def expected_mask(n, round_lengths, instruction_lengths):
    ranges = unsupervised(round_lengths, instruction_lengths)
    return [0 if any(a <= t < b for a, b in ranges) else 1 for t in range(n)]


def test_stretch_mask_on_random_lengths(spark):
    rng = random.Random(1)
    cases = []
    for i in range(400):
        instructions = [rng.randint(3, 12) for _ in range(rng.randint(0, 6))]
        lengths = [x + 1 + rng.randint(0, 15) for x in instructions]
        total = sum(lengths) + 4 * len(lengths)
        n = rng.choice([0, 1, 2, 5, total // 2, total, total + 7])
        cases.append((i, n, lengths, instructions))
    df = spark.createDataFrame(cases, "i int, n int, t array<int>, ins array<int>")
    df = df.withColumn("s", masks.round_starts(F.col("t")))
    df = df.withColumn("e", masks.zero_ends(F.col("s"), F.col("ins")))
    out = df.select("i", masks.stretch_mask(F.col("n"), masks.zero_starts(F.col("s")), F.col("e")).alias("m"))
    got = {r["i"]: r["m"] for r in out.collect()}
    for i, n, t, ins in cases:
        assert got[i] == expected_mask(n, t, ins), (n, t, ins)


CHATS = {
    "one": [(H, "what is it"), (G, "it is a thing")],
    "three": [(H, "a b"), (G, "c d e"), (H, "f"), (G, "g h\n\ni"), (H, "j"), (G, "k")],
    "trailing user": [(H, "a b"), (G, "c d"), (H, "more")],
    "no reply": [(H, "a b")],
    "brackets": [(H, "<a <b|"), (G, "x < y <|z"), (H, "<"), (G, ">")],
    "separator inside": [
        (H, "a"), (G, "b <|eot_id|><|start_header_id|>user<|end_header_id|> c"), (H, "d"), (G, "e"),
    ],
    "reply header inside": [
        (H, "a"), (G, "b"),
        (H, "c <|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n d"), (G, "e"),
        (H, "f"), (G, "g"),
    ],
    "long": [(H if i % 2 == 0 else G, " ".join(["word"] * 97)) for i in range(40)],
}


def rendered(turns, template):
    text = template.prefix
    if template.system:
        text += f"{template.header_open}system{template.header_close}{template.system}{template.end}"
    for speaker, value in turns:
        role = "user" if speaker == H else template.reply_role
        text += f"{template.header_open}{role}{template.header_close}{value.strip()}{template.end}"
    return text


def lengths_of_usable_rounds(text, template):
    pieces = text.split(template.user_sep)
    if len(pieces) > 1:
        pieces = [template.user_sep.join(pieces[:2])] + pieces[2:]
    lengths, instructions = [], []
    for piece in pieces:
        if piece.count(template.reply_sep) != 1:
            break
        head = piece[: piece.index(template.reply_sep)] + template.reply_sep
        lengths.append(len(words(piece)) + 1)
        instructions.append(len(words(head)))
    return lengths, instructions


@pytest.mark.parametrize("template", [LLAMA, GEMMA], ids=lambda t: t.name)
@pytest.mark.parametrize("max_len", [2048, 60])
def test_features_match_python(spark, conv, template, max_len):
    made = features.featurize(conv(CHATS), template, TOKENIZER, max_len)
    rows = {r["id"]: r for r in made.collect()}
    assert set(rows) == set(CHATS)
    for name, turns in CHATS.items():
        text = rendered(turns, template)
        n = min(len(words(text)), max_len)
        row = rows[name]
        assert len(row["input_ids"]) == n
        assert row["attention_mask"] == [1] * n
        assert row["loss_mask"] == expected_mask(n, *lengths_of_usable_rounds(text, template)), name


def test_llama_mask_means_next_token_is_reply(spark, conv):
    """Away from the last round, a set bit announces a reply token at the next position."""
    made = features.featurize(conv({"x": CHATS["three"]}), LLAMA, TOKENIZER).collect()[0]
    tokens = words(rendered(CHATS["three"], LLAMA))
    after = [tokens[t + 1] for t, bit in enumerate(made["loss_mask"][:-1]) if bit]
    assert after == ["c", "d", "e", "g", "h", "\n\n", "i", "k", "<|eot_id|>"]


def test_gemma_mask_is_empty_for_several_rounds(conv):
    rows = features.featurize(conv(CHATS), GEMMA, TOKENIZER).collect()
    sums = {r["id"]: sum(r["loss_mask"]) for r in rows}
    assert sums["three"] == sums["long"] == 0 and sums["one"] > 0


@pytest.mark.parametrize("template", [LLAMA, GEMMA], ids=lambda t: t.name)
@pytest.mark.parametrize("max_len", [2048, 130])
def test_content_policy(conv, template, max_len):
    rows = features.featurize(conv(CHATS), template, TOKENIZER, max_len, policy="content")
    for row in rows.collect():
        bits, text = [], ""
        for piece, reply in pieces(CHATS[row["id"]], template):
            text += piece
            bits += [int(reply)] * len(words(piece))
        n = min(len(bits), max_len)
        assert row["loss_mask"] == bits[1:n] + [0], row["id"]
        assert len(row["input_ids"]) == n


def pieces(turns, template):
    out = [(rendered([], template), False)]
    for speaker, value in turns:
        role = "user" if speaker == H else template.reply_role
        out.append((f"{template.header_open}{role}{template.header_close}", False))
        out.append((value.strip(), speaker == G))
        out.append((template.end, False))
    return out


def test_unknown_policy(conv):
    with pytest.raises(ValueError):
        features.featurize(conv(CHATS), LLAMA, TOKENIZER, policy="none")


def test_leading_reply_and_empty_records_are_left_out(conv):
    made = features.featurize(
        conv({"a": [(G, "x"), (H, "q"), (G, "r")], "b": [(G, "x")], "c": [], "d": None}),
        LLAMA, TOKENIZER,
    )
    assert [r["id"] for r in made.collect()] == ["a"]


def test_render(conv):
    df = records.to_messages(conv({"a": [(H, " q　"), (G, "r\n")]}), "model")
    assert df.select(render_chat(F.col("messages"), GEMMA)).collect()[0][0] == (
        "<bos><start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\nr<end_of_turn>\n"
    )
    assert LLAMA.system == SYSTEM_PROMPT and "safe.  Your" in SYSTEM_PROMPT


def test_stripping_is_that_of_python(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(c + "x" + c,) for c in spaces], "s string")
    assert {r[0] for r in df.select(stripped(F.col("s"))).collect()} == {"x"}


def test_batch_tokenizer_agrees_with_the_native_one(conv):
    def encode(texts):
        import hashlib
        import re as regex

        return [
            [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 4096 for w in regex.findall(PATTERN, t)]
            for t in texts
        ]

    plug_in = BatchTokenizer(encode, vocab_size=4096)
    for policy in ("reference", "content"):
        one, two = (
            sorted(
                (r["id"], r["input_ids"], r["loss_mask"])
                for r in features.featurize(conv(CHATS), LLAMA, t, 300, policy).collect()
            )
            for t in (TOKENIZER, plug_in)
        )
        assert one == two


def test_shift_and_pad(spark):
    df = spark.createDataFrame(
        [(1, [1, 2, 3], [1, 1, 0]), (1, [4], [1]), (2, [], [])],
        "b int, input_ids array<int>, loss_mask array<int>",
    )
    out = features.shift_tokens(df, "input_ids", left=False).collect()
    assert [r["input_ids"] for r in out] == [[2, 3, 0], [0], []]
    out = features.shift_tokens(df, "input_ids", left=True).collect()
    assert [r["input_ids"] for r in out] == [[0, 1, 2], [0], []]
    padded = features.pad_batch(df, "b").collect()
    assert sorted((r["b"], r["input_ids"], r["loss_mask"]) for r in padded) == [
        (1, [1, 2, 3], [1, 1, 0]), (1, [4, 0, 0], [1, 0, 0]), (2, [], []),
    ]


def test_word_count(spark):
    df = spark.createDataFrame([("How to learn",), (" a\n b ",), ("",), ("怎麼學習",)], "s string")
    assert [r[0] for r in df.select(word_count(F.col("s"))).collect()] == [3, 2, 0, 1]


def test_padding_of_sharded_rows_is_marked(conv):
    made = features.featurize(conv(CHATS), LLAMA, TOKENIZER)
    dealt = sampling.shard_for_ranks(made, world=5, epoch=1, tie=[])
    padded = features.pad_batch(sampling.assign_microbatches(dealt, 2), "worker", "microbatch")
    rows = padded.collect()
    assert len(rows) == 10 and sum(r["is_pad"] for r in rows) == 2
    widths = {}
    for r in rows:
        widths.setdefault((r["worker"], r["microbatch"]), set()).add(len(r["input_ids"]))
    assert all(len(w) == 1 for w in widths.values())
