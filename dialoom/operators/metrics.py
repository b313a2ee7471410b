"""Training metrics, draft acceptance, latency and throughput reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.text import word_count
from dialoom.operators.ranking import prefix_sums
from dialoom.operators.turn_table import join_null_safe
from dialoom.schema import LOSS_DECAY, MAX_TOKENS, TRIM_RATIO

# Fixed value: a metric line of the training log.
LOG_LINE = r"^(Train|Test) Epoch \[(\d+)/\d+\].*?(Acc|pLoss):\s*([0-9.]+)"
METRICS = ["Acc", "pLoss"]


def epoch_metrics(steps: DataFrame) -> DataFrame:
    """Mean over the steps of each worker, then plain mean over workers.

    ``steps`` has ``split, epoch, position, metric, worker, value``.
    """
    series = ["split", "epoch", "position", "metric"]
    per_worker = steps.groupBy(*series, "worker").agg(F.avg("value").alias("value"))
    return per_worker.groupBy(*series).agg(F.avg("value").alias("value"))


def parse_train_log(lines: DataFrame, require_rows: bool = True) -> DataFrame:
    """Metric rows ``split, epoch, metric, value`` from log text in column ``value``.

    A metric must start its line. ``require_rows`` looks for one match right away and
    raises ValueError when there is none.
    """
    line = F.col("value")

    def part(i: int):
        return F.regexp_extract(line, LOG_LINE, i)

    rows = lines.filter(line.rlike(LOG_LINE)).select(
        part(1).alias("split"),
        part(2).cast("int").alias("epoch"),
        part(3).alias("metric"),
        part(4).cast("double").alias("value"),
    )
    if require_rows and rows.isEmpty():
        raise ValueError("no Train/Test metric lines found")
    return rows


def log_epoch_means(rows: DataFrame) -> DataFrame:
    """Mean value per split, epoch and metric."""
    return rows.groupBy("split", "epoch", "metric").agg(F.avg("value").alias("value"))


def pivot_metrics(means: DataFrame) -> DataFrame:
    """One row per split and epoch, one column per metric."""
    return means.groupBy("split", "epoch").pivot("metric", METRICS).agg(F.first("value"))


def weighted_position_loss(steps: DataFrame, *step: str, base: float = LOSS_DECAY) -> DataFrame:
    """Sum over positions of ``base ** position * loss`` for every step."""
    weighted = F.pow(F.lit(base), F.col("position")) * F.col("loss")
    return steps.groupBy(*step).agg(F.sum(weighted).alias("ploss"))


def acceptance_accuracy(rows: DataFrame) -> DataFrame:
    """Share of supervised positions whose draft token is right, per draft step ``k``.

    ``rows``: one per sequence, with the arrays ``target`` (next tokens), ``mask``, ``kept`` (1
    where the target is in the draft vocabulary) and ``drafts``, one array of ids per step. The
    guess of step k at pos is held against the target at pos + k; absent truth has mask 0. A step
    without supervised positions reports 0. Sums are taken inside the rows, so nothing is
    exploded by position and one small row per sequence and step is aggregated.
    """

    def shifted(k: Column, name: str) -> Column:
        return F.slice(name, k + 1, F.greatest(F.size(name) - k, F.lit(0)))

    def step(draft: Column, k: Column) -> Column:
        mask = shifted(k, "mask")
        right = F.zip_with(draft, shifted(k, "target"), lambda d, t: F.coalesce((d == t).cast("int"), F.lit(0)))
        known = F.zip_with(mask, shifted(k, "kept"), lambda m, i: m * i)
        met = F.zip_with(known, right, lambda m, r: F.coalesce(m * r, F.lit(0)))
        # A guess must be there for its position to count.
        asked = F.zip_with(mask, draft, lambda m, d: F.when(d.isNotNull(), m).otherwise(0))
        return F.struct(k.alias("k"), total(met).alias("hits"), total(asked).alias("positions"))

    def total(counts: Column) -> Column:
        return F.aggregate(
            counts, F.lit(0).cast("bigint"), lambda x, y: x + F.coalesce(y, F.lit(0))
        )

    sums = rows.select(F.inline(F.transform("drafts", step))).groupBy("k")
    sums = sums.agg(F.sum("hits").alias("hits"), F.sum("positions").alias("positions"))
    return sums.withColumn("accuracy", F.col("hits") / (F.col("positions") + F.lit(1e-6)))


def trimmed_mean_latency(
    latency: DataFrame,
    *group: str,
    ratio: float = TRIM_RATIO,
    value: str = "seconds",
    margin: float = 0.0005,
    accuracy: int = 10_000,
) -> DataFrame:
    """Mean after dropping ``int(n * ratio)`` values at each end; all values when that is 0.

    The values of a group are never sorted in one place. Approximate quantiles just beside
    the two cuts slice each group in five; one aggregate gives the size and the sum of every
    slice, and only in the slices that a cut goes through (the two thin ones, usually) are
    distinct values put in order, in ranges of bounded size. Three passes over the values; the mean
    is exact whatever the quantiles' error. Null groups are groups like others.
    """
    keys = list(group)
    rows = latency.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    marks = [
        min(max(m, 0.0), 1.0)
        for cut in (ratio, 1 - ratio)
        for m in (cut - margin, cut + margin)
    ]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", marks, accuracy).alias("_marks"))
    # Slice = how many of the marks lie below the value.
    below = [F.when(F.get("_marks", F.lit(i)) < F.col("_v"), 1).otherwise(0) for i in range(4)]
    sliced = join_null_safe(rows, bounds, keys).select(
        *keys, "_v", (below[0] + below[1] + below[2] + below[3]).alias("_slice")
    )
    sizes = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_count"), F.sum("_v").alias("_sum")
    )
    up_to = Window.partitionBy(*keys).orderBy("_slice")
    cut_off = F.floor(F.col("_n") * F.lit(float(ratio)))
    k = F.when(cut_off * 2 < F.col("_n"), cut_off).otherwise(0)
    placed = (
        sizes.withColumn("_n", F.sum("_count").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.sum("_count").over(up_to) - F.col("_count"))
        .withColumn("_from", k)
        .withColumn("_to", F.col("_n") - k)
    )
    inside = (F.col("_before") >= F.col("_from")) & (
        F.col("_before") + F.col("_count") <= F.col("_to")
    )
    full = placed.filter(inside).select(*keys, "_sum", F.col("_count").alias("_kept"))
    outside = (F.col("_before") + F.col("_count") <= F.col("_from")) | (F.col("_before") >= F.col("_to"))
    crossed = placed.filter(~inside & ~outside).select(*keys, "_slice", "_before", "_from", "_to")
    by = [*keys, "_slice", "_before", "_from", "_to"]
    values = join_null_safe(sliced, crossed, [*keys, "_slice"]).groupBy(*by, "_v")
    values = values.agg(F.count(F.lit(1)).alias("_count"))
    values = prefix_sums(values, ["_v"], "_count", "_lesser", [*keys, "_slice"])
    first = F.col("_before") + F.col("_lesser")
    copies = F.greatest(
        F.lit(0),
        F.least(F.col("_first") + F.col("_count"), F.col("_to"))
        - F.greatest(F.col("_first"), F.col("_from")),
    )
    cut = values.withColumn("_first", first).withColumn("_copies", copies).select(
        *keys, (F.col("_v") * F.col("_copies")).alias("_sum"), F.col("_copies").alias("_kept")
    )
    return (
        full.unionByName(cut)
        .groupBy(*keys)
        .agg((F.sum("_sum") / F.sum("_kept")).alias("latency"))
    )


def quotient(dividend: Column, divisor: Column) -> Column:
    """``dividend / divisor`` of doubles in every mode of Spark; by zero infinite, or NaN for 0 / 0.

    The reciprocal of a zero is infinite and keeps its sign. A null on either side gives null.
    """
    dividend, divisor = dividend.cast("double"), divisor.cast("double")
    return F.when(divisor == 0, dividend * F.pow(divisor, F.lit(-1.0))).otherwise(dividend / divisor)


def throughput(
    latency: DataFrame, prompt: str = "prompt", max_tokens: int = MAX_TOKENS, batch: int = 1
) -> DataFrame:
    """Add nominal ``tokens_per_second``: prompt words plus ``max_tokens``, by latency.

    Assumes every request generated ``max_tokens`` tokens. A latency of 0 gives an infinite rate.
    """
    tokens = (word_count(F.col(prompt)) + max_tokens) * batch
    return latency.withColumn("tokens_per_second", quotient(tokens, F.col("latency")))


def speedup_report(baseline: DataFrame, candidate: DataFrame, *run: str) -> DataFrame:
    """Baseline latency over candidate latency for every run key in both tables.

    A candidate latency of 0 gives an infinite speedup.
    """
    base = baseline.select(*run, F.col("latency").alias("baseline"))
    return (
        join_null_safe(candidate.withColumnRenamed("latency", "candidate"), base, list(run))
        .withColumn("speedup", quotient(F.col("baseline"), F.col("candidate")))
    )
