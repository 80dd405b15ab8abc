"""The live rollup against the rollup of all events at once."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import events as ev
from tallyspark.operators import dimensions as dims
from tallyspark.operators import ranges, rollups, trends
from tallyspark.sources import usage_view
from tallyspark.sources.schema import MEASURES, ROLLUP_KEYS, ROLLUP_LABELS
from tallyspark.streaming import ingest, live

NOW = 1_741_780_800_000
DAY = 86_400_000


def lines(n, seed=1):
    """Records of several keys, labels and outcomes, some days late; several share a minute and key."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = NOW - r.choice([0, 0, 0, 29 * DAY, 3 * DAY]) - r.randrange(4) * 30_000
        out.append({
            "provider": f"p{r.randrange(2)}", "model": f"m{r.randrange(2)}", "api_key": r.choice(["", "k1", "k2"]), "auth_id": r.choice(["a1", "a2"]), "auth_type": "oauth", "source": r.choice(["", "team · name-of-a-team", "unknown"]),
            "requested_at_ms": at, "latency_ms": r.randrange(900), "ttft_ms": r.choice([0, r.randrange(90)]), "failed": r.random() < 0.2, "detail": {"input_tokens": r.randrange(50), "output_tokens": r.randrange(9), "cached_tokens": r.randrange(5)},
            "endpoint": f"/v1/{i}",
        })
    return [json.dumps(x) for x in out]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*ROLLUP_KEYS, *ROLLUP_LABELS, *MEASURES).collect())


def at_once(spark, texts):
    raw = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    return rollups.minute_rollup(ev.normalize_events(ev.compact_events(ev.decode_usage(raw).where("not malformed"))))


def numbered(spark, folder):
    """A stream of files with ids and texts."""
    return spark.readStream.schema("id long, raw string").option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("parts", [1, 3])
def test_live_equals_at_once(spark, tmp_path, parts):
    texts = [*lines(120), "broken {", "[]"]
    want = rows_of(at_once(spark, texts))
    pairs = list(enumerate(texts))
    random.Random(parts).shuffle(pairs)  # events of a minute come in any order
    (tmp_path / "in").mkdir()
    for p in range(parts):
        (tmp_path / f"in/{p}.json").write_text("\n".join(json.dumps({"id": i, "raw": t}) for i, t in pairs[p::parts]))
    table = live.LiveTable(spark, str(tmp_path / "live"))
    run = lambda: live.live_stream(numbered(spark, tmp_path / "in"), table, str(tmp_path / "ck")).awaitTermination(180)
    run()
    assert rows_of(table.rollups()) == want
    # the last batch again: its commit is lost, as when the driver dies after the write
    last = max((int(p.name) for p in (tmp_path / "ck/commits").iterdir() if p.name.isdigit()))
    for f in (tmp_path / "ck/commits").iterdir():
        if f.name.strip(".").removesuffix(".crc") == str(last):
            f.unlink()
    run()
    assert rows_of(table.rollups()) == want
    # and when it dies within the write: a folder without its mark is not read and written again
    shutil.rmtree(tmp_path / f"live/changes/batch={last}")
    (tmp_path / f"live/changes/batch={last}/event_date=2025-03-12").mkdir(parents=True)
    for f in (tmp_path / "ck/commits").iterdir():
        if f.name.strip(".").removesuffix(".crc") == str(last):
            f.unlink()
    run()
    assert rows_of(table.rollups()) == want
    table.compact()
    assert rows_of(table.rollups()) == want
    more = lines(15, seed=7)
    (tmp_path / "in/more.json").write_text("\n".join(json.dumps({"id": 1000 + i, "raw": t}) for i, t in enumerate(more)))
    run()
    everything = spark.createDataFrame([*enumerate(texts), *[(1000 + i, t) for i, t in enumerate(more)]], "id long, raw string")
    want = rows_of(rollups.minute_rollup(ev.normalize_events(ev.compact_events(ev.decode_usage(everything).where("not malformed")))))
    assert rows_of(table.rollups()) == want
    table.compact()
    table.compact()
    assert rows_of(table.rollups()) == want and len(list((tmp_path / "live/base").glob("batch=*"))) == 1 and not list((tmp_path / "live/changes").glob("batch=*"))


def test_queries_read_the_live_table(spark, tmp_path):
    texts = lines(60, seed=3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "raw": t}) for i, t in enumerate(texts)))
    table = live.LiveTable(spark, str(tmp_path / "live"))
    assert table.rollups().count() == 0
    live.live_stream(numbered(spark, tmp_path / "in"), table, str(tmp_path / "ck")).awaitTermination(180)
    prices, rng = usage_view.prices(spark), ranges.time_range(NOW + DAY, "7d")
    once = at_once(spark, texts)
    assert trends.summary_kpi(table.rollups(), prices, rng).collect() == trends.summary_kpi(once, prices, rng).collect()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(dims.interfaces(table.rollups(), prices, rng)) == key(dims.interfaces(once, prices, rng))


def test_records_later_than_the_retention_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = lambda at: json.dumps({"id": 1, "raw": json.dumps({"provider": "p", "model": "m", "requested_at_ms": at})})
    table = live.LiveTable(spark, str(tmp_path / "live"))
    run = lambda: live.live_stream(numbered(spark, tmp_path / "in"), table, str(tmp_path / "ck"), retention_days=2).awaitTermination(180)
    (tmp_path / "in/a.json").write_text(record(NOW))
    run()
    (tmp_path / "in/b.json").write_text(record(NOW - 3 * DAY) + "\n" + record(NOW - DAY))
    run()
    assert sorted(r.minute for r in table.rollups().collect()) == [(NOW - DAY) // 60_000, NOW // 60_000]


def test_distinct_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = lines(20, seed=5)
    (tmp_path / "in/a.jsonl").write_text("\n".join([*texts, texts[3], "broken {"]))
    source = lambda: ingest.record_stream(spark, str(tmp_path / "in"), 1)
    run = lambda: live.distinct_stream(source(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(180)
    run()
    (tmp_path / "in/b.jsonl").write_text("\n".join([texts[0], texts[7], lines(21, seed=5)[20].replace("p0", "p9")]))
    run()
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(texts) <= set(got) and len(got) == len({*texts, "broken {", lines(21, seed=5)[20].replace("p0", "p9")})
    table = live.LiveTable(spark, str(tmp_path / "live"))
    live.live_stream(ingest.record_stream(spark, str(tmp_path / "out")), table, str(tmp_path / "ck2")).awaitTermination(180)
    assert table.rollups().agg(F.sum("requests")).first()[0] == len(got) - 1
