import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialoom.functions.text import GEMMA, LLAMA
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators import features
from dialoom.operators import vocabulary as voc
from dialoom.plans.jobs import build_draft_vocab

H, G = "human", "gpt"


def _features(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, input_ids array<int>, loss_mask array<int>")


def test_only_supervised_positions_count(spark):
    df = _features(spark, [(1, [7, 7, 8], [1, 0, 1]), (0, [8, 9], [0, 1])])
    got = {r["token_id"]: (r["freq"], r["first_seen"]) for r in voc.token_frequency(df, "seq").collect()}
    assert got == {7: (1, (1, 0)), 8: (1, (1, 2)), 9: (1, (0, 1))}
    plain = {r["token_id"]: r["freq"] for r in voc.token_frequency(df).collect()}
    assert plain == {7: 1, 8: 1, 9: 1}


def test_first_seen_holds_for_long_rows_and_large_numbers(spark):
    """Positions beyond a million and row numbers near the end of 64 bits."""
    last = 2**62
    df = _features(spark, [(1, [7] * (2**20 + 1) + [9], [1] * (2**20 + 2)), (2, [8], [1]), (last, [5], [1])])
    freq = voc.token_frequency(df, "seq")
    order = [r["token_id"] for r in freq.orderBy("first_seen").collect()]
    assert order == [7, 9, 8, 5]


def test_ties_at_the_cut(spark):
    df = _features(spark, [(0, [9, 3, 9, 5, 3, 9], [1] * 6), (1, [2, 5], [1, 1])])
    freq = voc.token_frequency(df, "seq")
    assert [r["token_id"] for r in voc.top_n_tokens(freq, 2).collect()] == [9, 3]
    assert [r["token_id"] for r in voc.top_n_tokens(freq, 3).collect()] == [9, 3, 5]
    late = _features(spark, [(0, [5, 5, 3, 3], [1] * 4)])
    freq = voc.token_frequency(late, "seq")
    assert [r["token_id"] for r in voc.top_n_tokens(freq, 1).collect()] == [5]
    assert [r["token_id"] for r in voc.top_n_tokens(freq, 1, "token_id").collect()] == [3]
    with pytest.raises(ValueError):
        voc.top_n_tokens(freq, 1, "random")


def test_fewer_tokens_than_asked_for(spark):
    freq = spark.createDataFrame([(4, 10), (1, 5)], "token_id int, freq bigint")
    assert voc.top_n_tokens(freq, 100, "token_id").count() == 2
    row = voc.coverage_ratio(freq, 100).collect()[0]
    assert (row["top_freq"], row["total_freq"], row["coverage"]) == (15, 15, 1.0)
    assert voc.coverage_ratio(freq, 1).collect()[0]["coverage"] == pytest.approx(10 / 15)


def test_nothing_to_count_is_an_error(spark):
    empty = spark.createDataFrame([], "token_id int, freq bigint")
    with pytest.raises(PySparkException, match="no usable samples"):
        voc.coverage_ratio(empty, 5).collect()


def test_maps_and_round_trip(spark):
    top = spark.createDataFrame([(40, 1), (2, 9), (7, 3)], "token_id int, freq bigint")
    maps = voc.draft_to_target(top)
    got = [(r["draft_id"], r["token_id"], r["offset"]) for r in maps.orderBy("draft_id").collect()]
    assert got == [(0, 2, 2), (1, 7, 6), (2, 40, 38)]
    member = voc.target_in_draft(spark, maps, 50, 3).filter("in_draft").collect()
    assert sorted(r["token_id"] for r in member) == [2, 7, 40]
    tokens = spark.createDataFrame([(2,), (3,), (40,), (40,)], "token_id int")
    encoded = voc.encode_token_ids(tokens, maps, 3)
    decoded = voc.decode_draft_ids(encoded.select("draft_id"), maps, 3)
    assert sorted(r["token_id"] for r in decoded.collect()) == [2, 40, 40]
    # Without a size bound the join strategy is Spark's, with the same result.
    again = voc.decode_draft_ids(voc.encode_token_ids(tokens, maps).select("draft_id"), maps)
    assert sorted(r["token_id"] for r in again.collect()) == [2, 40, 40]


def test_merge_of_partial_counts(spark):
    one = spark.createDataFrame([(1, 5, 30), (2, 1, 7)], "token_id int, freq bigint, first_seen bigint")
    two = spark.createDataFrame([(1, 2, 4)], "token_id int, freq bigint, first_seen bigint")
    got = {r["token_id"]: (r["freq"], r["first_seen"]) for r in voc.merge_token_counts(one, two).collect()}
    assert got == {1: (7, 4), 2: (1, 7)}


def test_build(conv):
    data = {f"c_{i}": [(H, "question here"), (G, f"alpha alpha beta w{i}")] for i in range(6)}
    tokenizer = RegexTokenizer()
    for template in (LLAMA, GEMMA):
        built = build_draft_vocab(
            conv(data), template, tokenizer, draft_size=2, ties="token_id"
        )
        freq = {r["token_id"]: r["freq"] for r in built.frequency.collect()}
        kept = {r["token_id"]: r["freq"] for r in built.maps.collect()}
        assert sorted(kept.values(), reverse=True) == sorted(freq.values(), reverse=True)[:2]
        assert built.target_in_draft().filter("in_draft").count() == 2
        coverage = built.coverage.collect()[0]
        assert coverage["coverage"] == sum(kept.values()) / sum(freq.values())
    with pytest.raises(ValueError):
        build_draft_vocab(conv(data), LLAMA, tokenizer, 2)


def test_build_by_first_occurrence(conv):
    """The default order of equal counts."""
    data = {f"c_{i}": [(H, "q"), (G, f"a b w{i} w{i % 5} a"), (H, "r"), (G, "b")] for i in range(30)}
    df = conv(data).withColumn("n", F.substring_index("id", "_", -1).cast("bigint"))
    tokenizer = RegexTokenizer(vocab_size=16)
    rows = features.featurize(df, LLAMA, tokenizer, keep=("n",))
    top = voc.top_n_tokens(voc.token_frequency(rows, "n"), 3).collect()
    built = build_draft_vocab(df, LLAMA, tokenizer, 3, seq="n")
    assert {r["token_id"] for r in built.maps.collect()} == {r["token_id"] for r in top}


def test_kept_positions(spark):
    vocab = spark.createDataFrame([(2,), (5,)], "token_id int")
    rows = spark.createDataFrame([([5, 1, 2, 99],), ([],)], "target array<int>")
    kept = voc.kept_positions(rows, vocab, 8, 2).collect()
    assert [r["kept"] for r in kept] == [[1, 0, 1, 0], []]
