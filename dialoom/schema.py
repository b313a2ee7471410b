"""Record shapes and the constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

CONVERSATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversations", T.ArrayType(TURN)),
    ]
)

# Every spelling a source may use for a turn and for the list holding them.
LOOSE_TURN = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("from", "role", "value", "content")]
)

LOOSE_CONVERSATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversations", T.ArrayType(LOOSE_TURN)),
        T.StructField("items", T.ArrayType(LOOSE_TURN)),
        T.StructField("messages", T.ArrayType(LOOSE_TURN)),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Role spellings.
HUMAN = "human"
REPLY = "gpt"
HUMAN_SPELLINGS = ("human", "user")
REPLY_SPELLINGS = ("gpt", "assistant")

# Limits and seeds.
MAX_LEN = 2048
SEED = 42
TRAIN_RATIO = 0.95
SAMPLE_RATE = 0.01
LOSS_DECAY = 0.8
TRIM_RATIO = 0.2
MAX_TOKENS = 256
DRAFT_STEPS = 7

# Fixed value: the system message put in front of every Llama conversation.
SYSTEM_PROMPT = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as "
    "possible, while being safe.  Your answers should not include any harmful, unethical, "
    "racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses "
    "are socially unbiased and positive in nature.\n\nIf a question does not make any sense, "
    "or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
