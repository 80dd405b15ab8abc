"""Rollups by the hour and day, and pages that open only their days."""

import json
import random
from pathlib import Path

import pytest

from tallyspark.operators import events as ev
from tallyspark.operators import paging, ranges, rollups
from tallyspark.sources.tables import UsageTables

from test_usage import HOUR, NOW, event, frame

MINUTE, DAY = 60_000, 24 * HOUR


def some_events(n, days, seed):
    rnd = random.Random(seed)
    models, keys = ("vega-2", "lyra", "tarn"), ("u0", "u1")
    return [event(NOW - rnd.randrange(days * DAY), rnd.choice(models), rnd.random() < 0.3, rnd.randrange(900), rnd.randrange(90), upstream_key=rnd.choice(keys)) for _ in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    t.write_batch(frame(spark, some_events(300, 9, 1)), "a")
    t.write_batch(frame(spark, some_events(200, 4, 2)), "b")
    return t


def spoil(t, table, but=(), inside="*.parquet"):
    """Makes files of all days but some unreadable, so that a query that opens one fails."""
    spoiled = 0
    for file in Path(t.root).glob(f"gen-*/{table}/**/{inside}"):
        if not any(f"event_date={d}" in str(file) for d in but):
            file.write_bytes(b"spoiled")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoiled += 1
    return spoiled


def added(rows, rng, step):
    return sorted(map(tuple, rollups.bucket_model(rows, rng, step).collect()))


def test_spans_of_tiers():
    rnd = random.Random(5)
    for _ in range(300):
        first = rnd.randrange(6000)
        last, step = first + rnd.randrange(-1, 6000), rnd.choice((None, 15, 60, 360, 1440, 10080))
        spans = rollups.tier_spans(first, last, step)
        assert [m for n, a, b in spans for m in range(a, b + 1)] == list(range(first, last + 1))
        for n, a, b in spans:
            assert n == 1 or (a % n == 0 and (b + 1) % n == 0 and (step is None or step % n == 0))
        assert sum(b - a + 1 for n, a, b in spans if n == 1) < 120 or step == 15
    assert rollups.tier_spans(0, 10079, 10080) == [(1440, 0, 10079)]


def test_tiers_give_the_rows_of_minutes(spark, store):
    store.write_batch(frame(spark, some_events(120, 9, 3)), "b")  # replayed with other rows
    whole = store.partial_rollups()
    custom = ranges.time_range(NOW, "custom", NOW - 3 * DAY - 17 * MINUTE, NOW - DAY + 3 * MINUTE)
    for rng in (custom, *(ranges.time_range(NOW, x) for x in ("24h", "7d", "all"))):
        assert added(store.sums(rng, rng.interval), rng, rng.interval) == added(whole, rng, rng.interval)
    rng = ranges.time_range(NOW, "all")
    assert store.sums(rng).count() < whole.count()
    # retention: the minute of the horizon stays, what is before it in its hour and day does not
    store.prune(3, NOW + 31 * MINUTE)
    for step in (None, 60):
        assert added(store.sums(rng, step), rng, 1440) == added(store.partial_rollups(), rng, 1440)
    # batches written before there were tiers are read by minutes
    store.files.delete("gen-0/tiers/batch=a")
    assert added(store.sums(rng, 1440), rng, 1440) == added(store.partial_rollups(), rng, 1440)
    store.compact()
    assert added(store.sums(rng, 1440), rng, 1440) == added(store.partial_rollups(), rng, 1440)


def test_a_long_range_opens_no_minutes_but_at_its_ends(store):
    rng = ranges.time_range(NOW, "30d")
    want = added(store.partial_rollups(), rng, rng.interval)
    last = "2025-03-12"  # NOW is in the middle of it
    assert spoil(store, "rollups", [last])
    assert added(store.sums(rng, rng.interval), rng, rng.interval) == want
    assert spoil(store, "tiers", inside="tier=60/*.parquet", but=[last])
    assert added(store.sums(rng, rng.interval), rng, rng.interval) == want


def test_no_batches(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    assert t.sums(ranges.time_range(NOW, "all")).count() == 0 and t.day_counts() == {}
    assert t.page(ev.EventFilter()).count() == 0 and t.export(ev.EventFilter()).count() == 0


def test_pages_are_those_of_the_whole_table(store):
    every = [r.asDict() for r in store.events().collect()]
    key = min(r["upstream_key"] for r in every)
    cases = [
        ({}, lambda r: True),
        ({"model": "lyra", "upstream_key": key, "status": "failure"}, lambda r: r["model"] == "lyra" and r["upstream_key"] == key and r["failed"]),
        ({"search": "TAR", "to_ms": NOW - DAY}, lambda r: r["model"] == "tarn" and r["timestamp_ms"] <= NOW - DAY),
        ({"from_ms": NOW - 5 * DAY - 1000, "to_ms": NOW - DAY}, lambda r: NOW - 5 * DAY - 1000 <= r["timestamp_ms"] <= NOW - DAY),
        ({"model": "no such"}, lambda r: False),
    ]
    for horizon in (0, NOW - 6 * DAY):
        if horizon:
            store.prune(6, NOW)
        for f, fits in cases:
            want = sorted((r for r in every if fits(r) and r["timestamp_ms"] >= horizon), key=lambda r: (-r["timestamp_ms"], -r["id"]))
            for page in (1, 4):
                own = [(r.timestamp_ms, r.id) for r in store.page(ev.EventFilter(**f, page=page, page_size=25)).collect()]
                assert own == [(r["timestamp_ms"], r["id"]) for r in want[(page - 1) * 25 : page * 25]]
    f = ev.EventFilter(status="failure")
    assert [tuple(r) for r in store.export(f, 60).collect()] == [tuple(r) for r in ev.export_events(store.events(), f, 60).collect()]


def test_day_counts(spark, store):
    count = lambda: {r.event_date: r["count"] for r in store.events().groupBy("event_date").count().collect()}
    assert store.day_counts() == count()
    store.write_batch(frame(spark, some_events(50, 2, 4)), "a")
    assert store.day_counts() == count()
    # commits from before days were counted
    done = store.files.read("gen-0/commits/b.json")
    store.files.write("gen-0/commits/b.json", {k: v for k, v in done.items() if k != "days"})
    assert store.day_counts() == count()


def test_pages_open_only_their_days(store):
    counts = sorted(store.day_counts().items(), reverse=True)
    newest = str(counts[0][0])
    want = [tuple(r) for r in store.page(ev.EventFilter(page_size=10)).collect()]
    skip = sum(n for _, n in counts[:5])
    deep = ev.EventFilter(page=skip // 5 + 2, page_size=5)  # wholly within the sixth day
    assert counts[5][1] > 15
    deep_want = [tuple(r) for r in store.page(deep).collect()]
    spoil(store, "events", [newest, str(counts[5][0])])
    assert [tuple(r) for r in store.page(ev.EventFilter(page_size=10)).collect()] == want
    assert [tuple(r) for r in store.page(deep).collect()] == deep_want
    # under a condition days are counted newest first, no further than the page asks for
    spoil(store, "events", [newest])
    fitting = ev.EventFilter(status="failure", page_size=2)
    if counts[0][1] >= 20:
        assert store.page(fitting).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        store.page(deep).collect()


def test_events_without_a_time_come_last():
    stored = {None: 4, **{d: n for d, n in ()}}
    f = ev.EventFilter()
    assert paging.newest_days(stored, f) == [(None, 4)] and paging.newest_days(stored, ev.EventFilter(from_ms=1)) == []


def test_commits_tell_days(store):
    done = json.loads((Path(store.root) / "gen-0/commits/a.json").read_text())
    assert sum(done["days"].values()) == done["events"] == 300
