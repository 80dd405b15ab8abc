"""KPIs, trends, the health grid and series derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from .pricing import with_costs
from .ranges import CHINA_MS, MINUTE, TimeRange, health_range
from .rollups import bucket_model

RATIO_DIGITS, COST_DIGITS = 6, 9
LONG_MINUTES = 600
SPARK_POINTS = 14


def rounded(c: Column, digits: int = RATIO_DIGITS) -> Column:
    return F.round(c, digits)


def summary_kpi(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """The KPI block, one row."""
    rows = with_costs(bucket_model(rollups, rng), prices)
    names = {"requests": "requests", "successes": "successes", "failures": "failures", "total_tokens": "total_tokens", "input_tokens": "input_tokens", "output_tokens": "output_tokens",
             "cache_read_tokens": "cache_read_tokens", "cache_write_tokens": "cache_creation_tokens", "reasoning_tokens": "reasoning_tokens",
             "_latency": "latency_sum_ms", "_ttft": "ttft_sum_ms", "_ttft_count": "ttft_count"}
    sums = rows.agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in names.items()],
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_cost"), F.coalesce(F.sum("standard_cost_usd"), F.lit(0.0)).alias("_standard"), F.min("bucket").alias("_first"), F.max("bucket").alias("_last"),
    )
    c = F.col
    length = F.lit((rng.to_ms - rng.from_ms) / MINUTE)
    if rng.label == "all":
        length = F.coalesce((c("_last") - c("_first") + rng.interval).cast("double"), length)
    days, minutes = F.greatest(length / 1440, F.lit(1.0)), F.greatest(length, F.lit(1.0))
    shown = ["requests", "successes", "failures", "total_tokens", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
    return sums.select(
        F.lit(rng.label).alias("range_label"), *shown,
        rounded(c("_cost"), COST_DIGITS).alias("cost_usd"), rounded(c("_standard"), COST_DIGITS).alias("standard_cost_usd"),
        rounded(ratio(c("successes"), c("requests"))).alias("success_rate"), rounded(ratio(c("_latency"), c("requests"))).alias("avg_latency_ms"),
        rounded(ratio(c("_ttft"), c("_ttft_count"))).alias("avg_ttft_ms"), rounded(ratio(c("cache_read_tokens"), c("input_tokens"))).alias("cache_rate"),
        rounded(c("requests") / days).alias("avg_requests_daily"), rounded(c("total_tokens") / days).alias("avg_tokens_daily"), rounded(c("_cost") / days, COST_DIGITS).alias("avg_cost_daily"),
        rounded(c("requests") / minutes).alias("rpm"), rounded(c("total_tokens") / minutes).alias("tpm"),
    )


def trend(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """One point per bucket with data: tokens, costs, hit rate."""
    rows = with_costs(bucket_model(rollups, rng), prices)
    sums = rows.groupBy("bucket").agg(
        F.sum("requests").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cache_read_tokens").alias("cache_read"),
        F.sum("cache_creation_tokens").alias("cache_write"), F.sum("reasoning_tokens").alias("reasoning"), F.sum("cost_usd").alias("_cost"), F.sum("standard_cost_usd").alias("_standard"),
    )
    return sums.select(
        (F.col("bucket") * MINUTE).alias("timestamp_ms"), "requests", "tokens", "input", "output", "cache_read", "cache_write", "reasoning",
        rounded(F.col("_cost"), COST_DIGITS).alias("cost_usd"), rounded(F.col("_standard"), COST_DIGITS).alias("standard_cost_usd"), rounded(ratio(F.col("cache_read"), F.col("input"))).alias("hit_rate"),
    )


def _dense(points: DataFrame, bounds: DataFrame, step_ms: int) -> DataFrame:
    """Every step of `bounds` (lo, hi; nulls: no row) with the point there, or zeros."""
    grid = bounds.where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(step_ms).cast("long"))).alias("timestamp_ms"))
    joined = grid.join(points, "timestamp_ms", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(points.schema[c].dataType)).alias(c) for c in points.columns if c != "timestamp_ms"}
    return joined.select("timestamp_ms", *zero.values())


def trend_dense(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """The trend without gaps: over the whole range if that is short, else between the first and last points."""
    points = trend(rollups, prices, rng)
    step = rng.interval
    first, last = (m // step * step for m in rng.minutes)
    if last - first > LONG_MINUTES or rng.label == "all":
        bounds = points.agg(F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))
    else:
        bounds = points.agg(F.when(F.count(F.lit(1)) > 0, F.lit(first * MINUTE).cast("long")).alias("lo"), F.lit(last * MINUTE).cast("long").alias("hi"))
    return _dense(points, bounds, step * MINUTE)


def trend_nonempty(dense: DataFrame) -> DataFrame:
    return dense.where(F.greatest("requests", "tokens", "input", "output", "cache_read", "reasoning") + F.col("cost_usd") > 0)


def health_grid(rollups: DataFrame, now_ms: int) -> DataFrame:
    """480 quarter hours of five days at UTC+8 with requests, failures, success rate, and their places in the grid."""
    rng = health_range(now_ms)
    rows = bucket_model(rollups, rng).groupBy("bucket").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))
    points = rows.select((F.col("bucket") * MINUTE).alias("timestamp_ms"), "requests", "failures")
    first, last = (m // rng.interval * rng.interval for m in rng.minutes)
    bounds = rollups.sparkSession.range(1).select(F.lit(first * MINUTE).cast("long").alias("lo"), F.lit(last * MINUTE).cast("long").alias("hi"))
    grid = _dense(points, bounds, rng.interval * MINUTE)
    place = F.expr(f"(timestamp_ms - {rng.from_ms}) div {rng.interval * MINUTE}")
    local = F.date_format(F.timestamp_millis(F.col("timestamp_ms") + CHINA_MS), "yyyy-MM-dd")
    rate = ratio(F.col("requests") - F.col("failures"), F.col("requests"))
    return grid.select("timestamp_ms", "requests", "failures", rounded(rate).alias("success_rate"), F.floor(place / 96).alias("day_index"), (place % 96).alias("slot_index"), local.alias("day"))


def health_levels(grid: DataFrame) -> DataFrame:
    """Level 0 (no requests) to 5 of each point; the best level asks for more with more requests."""
    total = F.col("requests").cast("double")
    rate = ratio(F.greatest(F.col("requests") - F.col("failures"), F.lit(0)), F.col("requests"))
    green = F.least(F.lit(0.99), F.lit(0.9) + F.lit(0.045) * F.greatest(F.lit(0.0), F.log10(total / 10)))
    level = F.when(total == 0, 0).when(rate < 0.5, 1).when(rate < 0.65, 2).when(rate < 0.8, 3).when(rate < green, 4).otherwise(5)
    return grid.select("timestamp_ms", "requests", "failures", level.alias("level"))


def health_totals(grid: DataFrame) -> DataFrame:
    sums = grid.agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))
    good = F.greatest(F.col("requests") - F.col("failures"), F.lit(0))
    return sums.select("requests", good.alias("successes"), "failures", rounded(ratio(good, F.col("requests"))).alias("success_rate"))


def sparkline(points: DataFrame, value: str, most: int = SPARK_POINTS) -> DataFrame:
    """At most `most` evenly spaced points of a trend (index from 0, value); a single one comes twice.

    points are a trend's, so their number is bounded by the range, not by the data.
    """
    numbered = points.select(F.row_number().over(Window.orderBy("timestamp_ms")).alias("n"), F.col(value).cast("double").alias("value"))
    n = numbered.agg(F.count(F.lit(1)).alias("points"))
    count = F.least(F.col("points"), F.lit(most))
    wanted = n.where("points > 0").select("points", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(1)))).alias("index"))
    # half up: the exact middle goes to the later point
    at = F.when(F.col("points") == 1, F.lit(0)).otherwise(F.expr(f"(2 * index * (points - 1) + (least(points, {most}) - 1)) div (2 * (least(points, {most}) - 1))"))
    return wanted.withColumn("n", at + 1).join(numbered, "n").select("index", "value")


def token_composition(sums: DataFrame) -> DataFrame:
    """Five disjoint parts of the tokens of one row (input, output, cache_read, cache_write, reasoning) and their shares in percent."""
    part = lambda e: f"greatest({e}, 0)"
    rows = sums.select(F.expr(
        f"stack(5, 'input', {part('input - cache_read - cache_write')}, 'output', {part('output - reasoning')}, 'cache_read', cache_read, 'cache_write', cache_write, 'reasoning', reasoning) as (part, tokens)"
    ))
    total = F.sum("tokens").over(Window.partitionBy())  # five rows
    return rows.select("part", "tokens", rounded(ratio(F.col("tokens") * 100, total)).alias("percent"))


