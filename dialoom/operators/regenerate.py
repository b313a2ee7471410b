"""Replay of conversations through a text generator, and batch-wise Python functions.

The generator is the one part that has to be Python. Spark spreads the conversations; inside
a task a thread per concurrent request keeps the remote service busy.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from dialoom.schema import HUMAN, REPLY

REGENERATED = (
    "id string, idx bigint, conversations array<struct<`from`:string,value:string>>, "
    "attempts array<int>, errors array<string>"
)


class GenerationError(Exception):
    """A refusal of the service with an HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"HTTP {status}")
        self.status_code = status


@dataclass(frozen=True)
class RetryPolicy:
    """Retry of HTTP 4xx/5xx with waits of 1, 2, ... seconds up to ``max_wait``.

    ``max_attempts`` bounds what would otherwise repeat for ever. ``min_interval`` is the least time
    between two calls of a job, on average: each task that can run beside others waits as many times
    as long. Any other failure ends at once.
    """

    min_interval: float = 0.1
    first_wait: float = 1.0
    wait_step: float = 1.0
    max_wait: float = 10.0
    max_attempts: int = 20
    on_error: str = "empty"


@dataclass
class _Pace:
    """Spaces the calls made by the threads of one task."""

    interval: float
    next_at: float = 0.0
    lock: object = field(default=None)

    def wait(self) -> None:
        if self.interval <= 0:
            return
        with self.lock:
            start = max(time.monotonic(), self.next_at)
            self.next_at = start + self.interval
        time.sleep(max(0.0, start - time.monotonic()))


def _status_of(error: Exception) -> int | None:
    for holder in (error, getattr(error, "response", None)):
        for name in ("status_code", "http_status"):
            code = getattr(holder, name, None)
            if isinstance(code, int):
                return code
    return None


def call_with_retry(
    generate: Callable[[str], str], prompt: str, policy: RetryPolicy, pace: _Pace | None = None
) -> tuple[str | None, str | None, int]:
    """``(reply, error, attempts)`` of one call; a failed call replies ``""`` by default."""
    wait = policy.first_wait
    attempt = 0
    while True:
        attempt += 1
        if pace is not None:
            pace.wait()
        try:
            return generate(prompt), None, attempt
        except Exception as error:  # the generator is foreign code
            code = _status_of(error)
            retry = code is not None and 400 <= code < 600 and attempt < policy.max_attempts
            if not retry:
                if policy.on_error == "fail":
                    raise
                reply = "" if policy.on_error == "empty" else None
                return reply, str(error) or type(error).__name__, attempt
        time.sleep(wait)
        wait = min(wait + policy.wait_step, policy.max_wait)


def _replay(turns, call) -> tuple[list[dict], list[int], list[str | None]]:
    """New turns of one conversation; every prompt holds the new replies before it."""
    new_turns, attempts, errors = [], [], []
    context: list[str] = []
    for turn in turns if turns is not None else []:
        if turn["from"] == HUMAN:
            value, label = turn["value"], "Human"
        elif turn["from"] == REPLY:
            value, error, tries = call("".join(context) + "Assistant:")
            attempts.append(tries)
            errors.append(error)
            label = "Assistant"
        else:
            continue
        new_turns.append({"from": turn["from"], "value": value})
        context.append(f"{label}: {value if value is not None else ''}\n\n")
    return new_turns, attempts, errors


# Conversations of one task: what a lost executor has to repeat at most.
TASK_ROWS = 2_000


def regenerate_replies(
    conv: DataFrame,
    generate: Callable[[str], str],
    policy: RetryPolicy = RetryPolicy(),
    partitions: int | None = None,
    threads: int = 8,
) -> DataFrame:
    """Replace every reply of ``conv(id, idx, conversations)`` by a generated one.

    Roles must already be canonical. Conversations are dealt out evenly to ``partitions`` tasks,
    as the calls cost far more than the shuffle: all cores by default, and more tasks where these
    would get over ``TASK_ROWS`` conversations. Each task keeps ``threads`` conversations going
    and hands on each one as it ends, in any order. Within a conversation calls are sequential
    because prompts build on earlier replies. A retried task calls the service again, so save in
    batches and continue with what is missing.
    """
    cores = conv.sparkSession.sparkContext.defaultParallelism
    tasks = partitions
    if tasks is None:
        tasks = max(cores, -(-conv.count() // TASK_ROWS))
    source = conv.select("id", "idx", "conversations").repartition(tasks)
    interval = policy.min_interval * min(tasks, cores)  # of each of the tasks that share the rate

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from threading import Lock

        pace = _Pace(interval, lock=Lock())

        def one(row):
            made = _replay(row[2], lambda p: call_with_retry(generate, p, policy, pace))
            return (row[0], row[1], *made)

        def rows():
            for batch in batches:
                yield from zip(batch["id"], batch["idx"], batch["conversations"])

        def frame(done: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(done, columns=["id", "idx", "conversations", "attempts", "errors"])

        waiting, done = set(), []
        with ThreadPoolExecutor(threads) as pool:
            for row in rows():
                waiting.add(pool.submit(one, row))
                if len(waiting) < 2 * threads:
                    continue
                ended, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                done += [f.result() for f in ended]
                if len(done) >= 4 * threads:
                    yield frame(done)
                    done = []
            done += [f.result() for f in waiting]
        if done:
            yield frame(done)

    return source.mapInPandas(run, REGENERATED)


def generate_for_prompts(
    prompts: DataFrame,
    generate: Callable[[str], str],
    policy: RetryPolicy = RetryPolicy(),
    threads: int = 8,
) -> DataFrame:
    """One call per row: adds ``reply, error, attempts`` to ``prompts(id, pos, prompt)``."""
    interval = policy.min_interval * prompts.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from threading import Lock

        pace = _Pace(interval, lock=Lock())
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                done = list(
                    pool.map(lambda p: call_with_retry(generate, p, policy, pace), batch["prompt"])
                )
                yield pd.DataFrame(
                    {
                        "id": batch["id"],
                        "pos": batch["pos"],
                        "reply": [d[0] for d in done],
                        "error": [d[1] for d in done],
                        "attempts": [d[2] for d in done],
                    }
                )

    return prompts.select("id", "pos", "prompt").mapInPandas(
        run, "id string, pos bigint, reply string, error string, attempts int"
    )


def map_batched(df: DataFrame, fn: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """Apply ``fn`` to columnar batches; it may drop rows and replaces all columns.

    ``fn`` takes and returns a pandas DataFrame, or a ``pyarrow.RecordBatch`` with
    ``arrow=True``. Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema) if arrow else df.mapInPandas(run, schema)
