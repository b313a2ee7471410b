"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.functions.masks import shift_left
from dialoom.functions.text import LLAMA
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators import features as feat
from dialoom.operators import turn_table as tt
from dialoom.schema import DRAFT_STEPS, MAX_LEN
from dialoom.session import fresh_path

TOKENIZER = RegexTokenizer(vocab_size=4096)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn table: user and assistant renamed, system turns kept."""
    role = F.col("role")
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("sharegpt_"), F.col("conv_id").cast("string")).alias("id"),
        "conv_id",
        F.col("turn").alias("pos"),
        speaker.alias("from"),
        F.col("text").alias("value"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human and reply turns: ``id, conv_id, pos, from, value``."""
    return tt.keep_dialogue_roles(raw_turns(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records ``id, conversations``, all roles kept."""
    return tt.collect_turns(raw_turns(spark, sf_dir))


def dialogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole dialogues in one row each, for prompts that need everything said before."""
    return tt.collect_turns(dialogue(spark, sf_dir))


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue where the last reply of every tenth conversation has no text."""
    turns = dialogue(spark, sf_dir)
    tenth = turns.filter((F.col("from") == "gpt") & (F.col("conv_id") % 10 == 0))
    last = tenth.groupBy("id").agg(F.max("pos").alias("pos")).withColumn("_last", F.lit(True))
    return (
        turns.join(last, ["id", "pos"], "left")
        .withColumn("value", F.when(F.col("_last"), "").otherwise(F.col("value")))
        .drop("_last")
    )


def emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blanked`` without trailing human turns."""
    turns = blanked(spark, sf_dir)
    return tt.drop_trailing_human(tt.numbered(turns)).drop("empty", "ord")


def trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records, ready for featurizing, with their integer order ``conv_id``."""
    nested = feat.trainable_records(raw_turns(spark, sf_dir))
    return nested.withColumn("conv_id", F.substring_index("id", "_", -1).cast("bigint"))


def llama_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("id", "conv_id")
    return feat.featurize(trainable(spark, sf_dir), LLAMA, TOKENIZER, MAX_LEN, keep=keep)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows written once, for queries that use them several times."""
    path = fresh_path(spark, "features")
    llama_features(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def truth(features: DataFrame) -> DataFrame:
    """Next-token targets ``seq, pos, target_id, mask``."""
    targets = F.posexplode(shift_left(F.col("input_ids"))).alias("pos", "target_id")
    return features.select(F.col("conv_id").alias("seq"), "loss_mask", targets).select(
        "seq", "pos", "target_id", F.get("loss_mask", F.col("pos")).alias("mask")
    )


def drafts(features: DataFrame) -> DataFrame:
    """Feature rows as ``seq, target, mask, drafts``, with made-up guesses of every draft step:
    right where a digest starts with a digit."""
    rows = features.select(
        F.col("conv_id").alias("seq"), shift_left(F.col("input_ids")).alias("target"),
        F.col("loss_mask").alias("mask"),
    )

    def guess(k):
        def at(target, pos):
            digest = F.md5(F.concat_ws(":", F.col("seq"), pos, F.lit(k)))
            right = F.substring(digest, 1, 1).between("0", "9")
            return F.when(right, target).otherwise((target + 1) % TOKENIZER.vocab_size)

        return F.transform("target", at)

    return rows.withColumn("drafts", F.array(*[guess(k) for k in range(DRAFT_STEPS)]))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step metrics out of events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 5 == 0, "Test").otherwise("Train").alias("split"),
        F.dayofmonth("ts").alias("epoch"),
        (e % 7).cast("int").alias("position"),
        (F.col("user_id") % 4).cast("int").alias("worker"),
        F.when(e % 2 == 0, "Acc").otherwise("pLoss").alias("metric"),
        "value",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-log lines; every eleventh is preceded by a line that is not a metric."""
    line = F.concat(
        F.col("split"), F.lit(" Epoch ["), F.col("epoch").cast("string"), F.lit("/40], position "),
        F.col("position").cast("string"), F.lit(",  "), F.col("metric"), F.lit(": "),
        F.format_string("%.2f", "value"),
    )
    noise = F.concat(F.lit("progress 10% "), line)
    lines = F.when(F.col("event_id") % 11 == 0, F.array(noise, line)).otherwise(F.array(line))
    return steps(spark, sf_dir).select(F.explode(lines).alias("value"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``engine, run, seconds`` out of events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("engine"),
        F.dayofmonth("ts").alias("run"),
        F.col("value").alias("seconds"),
    )


