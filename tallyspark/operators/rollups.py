"""Minute rollups: build, merge, read; retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import MEASURES, ROLLUP_KEYS, ROLLUP_LABELS, TOKENS
from .ranges import DAY, MINUTE, TimeRange


#: Minutes of the coarser rollups kept beside the minutes, coarsest first.
TIERS = (1440, 60)

#: The order of events that decides whose labels stay; the label itself comes last.
LAST = ("timestamp_ms", "id")


def measures() -> dict[str, Column]:
    """The 13 sums over events."""
    c = F.col
    return {
        "requests": F.count(F.lit(1)), "successes": F.count_if(~c("failed")), "failures": F.count_if(c("failed")),
        **{t: F.sum(t) for t in TOKENS}, "latency_sum_ms": F.sum("latency_ms"), "ttft_sum_ms": F.sum("ttft_ms"), "ttft_count": F.count_if(c("ttft_ms") > 0),
    }


def minute_rollup(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Events by minute and five dimensions: 13 sums, and the labels of the latest event. `by`: columns that hang on those, by which the events are dealt out."""
    labels = [F.max_by(x, F.struct(*LAST, x)).alias(x) for x in ROLLUP_LABELS]
    one = measures()
    return events.withColumn("minute", F.expr(f"timestamp_ms div {MINUTE}")).groupBy(*by, *ROLLUP_KEYS).agg(*labels, *[one[m].alias(m) for m in MEASURES])


def merge_rollups(partials: DataFrame, order: str = "batch_id") -> DataFrame:
    """One row per key of partial rollups: measures are added, labels of the latest batch win. An event_date is kept, so ranges on it still prune folders."""
    labels = [F.max_by(x, F.struct(order, x)).alias(x) for x in ROLLUP_LABELS]
    day = ["event_date"] if "event_date" in partials.columns else []
    return partials.groupBy(*ROLLUP_KEYS, *day).agg(*labels, *[F.sum(m).alias(m) for m in MEASURES])


def rollups_in(rollups: DataFrame, rng: TimeRange, **equal: str) -> DataFrame:
    """Rollup rows of a range, by whole minutes at both ends; other conditions by name."""
    first, last = rng.minutes
    out = rollups.where(F.col("minute").between(first, last))
    if "event_date" in rollups.columns:
        # the partition column is derived from the minute, so its bounds prune folders
        day = lambda m: F.lit(m // 1440).cast("int")
        out = out.where(F.col("event_date").between(F.date_from_unix_date(day(first)), F.date_from_unix_date(day(last))))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def coarser_rollups(partials: DataFrame, tiers: tuple[int, ...] = TIERS, by: tuple[str, ...] = ("event_date",)) -> DataFrame:
    """Minute rollups added up by the hour and the day: `tier` (in minutes), its first minute, keys and measures, no labels."""
    spread = partials.withColumn("tier", F.explode(F.array(*[F.lit(n) for n in tiers]))).withColumn("minute", F.expr("minute div tier * tier"))
    return spread.groupBy(*by, "tier", *ROLLUP_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def tier_spans(first: int, last: int, step: int | None = None, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int]]:
    """Spans (tier, first and last minute) that make up first..last without overlap, of the coarsest tiers that fit.

    Tiers that cross the bounds of buckets of `step` minutes are not used; None: there are no buckets.
    """
    usable = [n for n in tiers if step is None or step % n == 0]

    def cover(lo: int, end: int, left: list[int]) -> list[tuple[int, int, int]]:
        if lo >= end:
            return []
        if not left:
            return [(1, lo, end - 1)]
        n = left[0]
        a, b = -(-lo // n) * n, end // n * n
        if a >= b:
            return cover(lo, end, left[1:])
        return [*cover(lo, a, left[1:]), (n, a, b - 1), *cover(b, end, left[1:])]

    return cover(first, last + 1, usable)


def in_spans(rows: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Rows whose minute is in one of some spans (both ends inclusive); the spans' days prune folders."""
    fits = F.lit(False)
    for a, b in spans:
        days = [F.date_from_unix_date(F.lit(m // 1440).cast("int")) for m in (a, b)]
        fits = fits | (F.col("event_date").between(*days) & F.col("minute").between(a, b))
    return rows.where(fits)


def bucket_model(rollups: DataFrame, rng: TimeRange, interval: int | None = None) -> DataFrame:
    """Sums by bucket of `interval` minutes (its first minute, aligned to the epoch) and model."""
    n = interval or rng.interval
    rows = rollups_in(rollups, rng).withColumn("bucket", F.expr(f"(minute div {n}) * {n}"))
    return rows.groupBy("bucket", "model").agg(*[F.sum(m).alias(m) for m in MEASURES])


def surviving_events(events: DataFrame, days: int, now_ms: int) -> DataFrame:
    return events.where(F.col("timestamp_ms") >= now_ms - days * DAY)


def surviving_rollups(rollups: DataFrame, days: int, now_ms: int) -> DataFrame:
    """The boundary minute survives as a whole."""
    return rollups.where(F.col("minute") >= (now_ms - days * DAY) // MINUTE)


def table_status(events: DataFrame, rollups: DataFrame) -> DataFrame:
    """events, rollups, last_event_ms: one row."""
    a = events.agg(F.count(F.lit(1)).alias("events"), F.max("timestamp_ms").alias("last_event_ms"))
    return a.join(F.broadcast(rollups.agg(F.count(F.lit(1)).alias("rollups"))))  # two single rows
