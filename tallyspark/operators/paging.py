"""Pages and exports of stored events that open only the days their rows are in.

Stored events are cut by UTC day, and commits tell how many events a day has. Newest first is
first by day and then within a day, so the rows of a page lie in a few consecutive days: those are
found from the counts, and nothing else is read. Under conditions the counts only bound the fitting
rows, so fitting rows are counted (by the columns of the conditions) for the newest days, then for
twice as many more, and so on until the page is covered.

Days are at most as many as retention keeps, so their counts may stand on the driver.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import events as ev
from .ranges import DAY

Counts = list[tuple[date | None, int]]


def _start_ms(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def _on(days: list[date | None]) -> Column:
    """The condition that an event's day is one of some consecutive days; events without a time have none."""
    known = [d for d in days if d is not None]
    none = F.col("event_date").isNull()
    if not known:
        return none
    within = F.col("event_date").between(F.lit(min(known)), F.lit(max(known)))
    return within if len(known) == len(days) else within | none


def newest_days(stored: dict[date | None, int], f: ev.EventFilter) -> Counts:
    """Days that a filter's times leave, newest first, events without a time last."""
    timed = f.from_ms > 0 or f.to_ms > 0
    left = [d for d in stored if d is not None and (f.to_ms <= 0 or _start_ms(d) <= f.to_ms) and (f.from_ms <= 0 or _start_ms(d) + DAY > f.from_ms)]
    blank = [] if timed or None not in stored else [None]
    return [(d, stored[d]) for d in [*sorted(left, reverse=True), *blank]]


def _whole(day: date | None, f: ev.EventFilter, horizon_ms: int | None) -> bool:
    """Whether all stored events of a day fit, so that its count is known."""
    if any(getattr(f, name) for name in ("model", "provider", "api_key_hash", "upstream_key", "status", "search")):
        return False
    if day is None:
        return True
    start = _start_ms(day)
    return start >= max(f.from_ms, horizon_ms or 0) and (f.to_ms <= 0 or start + DAY - 1 <= f.to_ms)


def fitting_days(events: DataFrame, f: ev.EventFilter, stored: dict[date | None, int], rows: int, horizon_ms: int | None = None) -> Counts:
    """Fitting events of the newest days, until they are `rows` or no day is left."""
    order, out, found, at, step = newest_days(stored, f), [], 0, 0, 1
    while at < len(order) and found < rows:
        # no fewer days than could hold what is missing, and in each round twice as many
        end, bound = at, 0
        while end < len(order) and (end - at < step or bound < rows - found):
            bound += order[end][1]
            end += 1
            if bound >= rows - found and all(_whole(d, f, horizon_ms) for d, _ in order[at:end]):
                break
        own = order[at:end]
        unknown = [d for d, _ in own if not _whole(d, f, horizon_ms)]
        counted = {}
        if unknown:
            known = F.col("event_date").isin([d for d in unknown if d is not None])
            mine = known | F.col("event_date").isNull() if None in unknown else known
            hits = ev.filter_events(events, f).where(mine).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
            counted = {r.event_date: r.n for r in hits.collect()}
        own = [(d, counted.get(d, 0) if d in unknown else n) for d, n in own]
        out += own
        found += sum(n for _, n in own)
        at, step = end, step * 2
    return out


def newest_rows(events: DataFrame, f: ev.EventFilter, stored: dict[date | None, int], skip: int, rows: int, horizon_ms: int | None = None) -> DataFrame:
    """Fitting events from place `skip` of the order newest first, `rows` of them, read from the days they are in."""
    before, first, days = 0, 0, []
    for day, n in fitting_days(events, f, stored, skip + rows, horizon_ms):
        if n and before < skip + rows and before + n > skip:
            if not days:
                first = before
            days.append(day)
        before += n
    fitting = ev.filter_events(events, f).where(_on(days) if days else F.lit(False))
    return ev.newest(fitting).offset(skip - first if days else 0).limit(rows)


def events_page(events: DataFrame, f: ev.EventFilter, stored: dict[date | None, int], horizon_ms: int | None = None) -> DataFrame:
    """One page of redacted events, newest first."""
    return ev.redact_events(newest_rows(events, f, stored, (f.page - 1) * f.page_size, f.page_size, horizon_ms))


def export_events(events: DataFrame, f: ev.EventFilter, stored: dict[date | None, int], most: int = 50_000, horizon_ms: int | None = None) -> DataFrame:
    """The newest `most` events that fit, redacted, with the columns of the CSV export."""
    return ev.exported(newest_rows(events, f, stored, 0, most, horizon_ms))
