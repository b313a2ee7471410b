"""Conversations that arrive turn by turn: closed after a pause, cleaned, appended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dialoom.operators.records import clean_conversations, keep_dialogue_roles

TURN = "id string, pos bigint, `from` string, value string, ts timestamp"
RECORD = "id string, pos array<bigint>, speakers array<string>, values array<string>"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Turns of one conversation as a list that grows by appending, and a timer that closes it.

    Every turn moves the timer to its own time and the pause, if that is later. When the watermark
    passes it, the conversation leaves the state as one record.
    """

    def __init__(self, pause_ms: int) -> None:
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "pos bigint, speaker string, value string")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.due.get()[0] if self.due.exists() else None
        latest, new = before, []
        for batch in rows:
            columns = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("pos", "speaker", "value", "at"))
            for pos, speaker, value, at in zip(*columns):
                new.append((None if pos is None else int(pos), speaker, value))
                due = (0 if at is None else int(at)) + self.pause_ms
                latest = due if latest is None else max(latest, due)
        self.turns.appendList(new)
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(latest)
            self.due.update((latest,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns = list(self.turns.get())
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        self.turns.clear()
        self.due.clear()
        pos, speakers, values = map(list, zip(*turns))
        yield pd.DataFrame({"id": [key[0]], "pos": [pos], "speakers": [speakers], "values": [values]})

    def close(self) -> None:
        pass


def gather_conversations(turns: DataFrame, pause_seconds: float, lateness: str) -> DataFrame:
    """A stream of turns ``id, pos, from, value, ts`` to a stream of records ``id, conversations``.

    A conversation is complete when no turn has come for ``pause_seconds`` of event time and the watermark
    (the latest time seen less ``lateness``) is past that. Turns are put in order of ``pos``. A turn
    behind the watermark is dropped; one that follows a closed conversation begins another with
    that id. Null ids make one conversation. The state holds open conversations only.
    """
    timed = turns.withWatermark("ts", lateness).select(
        "id", "pos", F.col("from").alias("speaker"), "value", F.unix_millis("ts").alias("at"), "ts"
    )
    closed = timed.groupBy("id").transformWithStateInPandas(
        Gather(int(pause_seconds * 1000)), RECORD, outputMode="append", timeMode="eventtime"
    )
    turn = F.zip_with("speakers", "values", lambda s, v: F.struct(s.alias("from"), v.alias("value")))
    return closed.select("id", turn.alias("conversations"))


def stream_conversations(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, pause_seconds: float = 600,
    lateness: str = "1 minute", max_files: int | None = None,
) -> StreamingQuery:
    """Turns from JSONL files (``TURN``) to cleaned records in ``out_dir``, as conversations close.

    Runs until all files present are done; open conversations stay in the checkpoint's state for the
    next run. The file sink commits every micro-batch once.
    """
    reader = spark.readStream.schema(TURN).option("mode", "FAILFAST")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = gather_conversations(reader.json(in_dir), pause_seconds, lateness)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:  # the query takes the setting with it when it starts
        return (
            clean_conversations(keep_dialogue_roles(records))
            .writeStream.format("json")
            .option("path", out_dir)
            .option("checkpointLocation", checkpoint)
            .option("ignoreNullFields", False)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
