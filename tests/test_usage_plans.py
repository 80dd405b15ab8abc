"""Plans, files and rare paths of the usage side."""

import csv
import io
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.operators import dimensions as dims
from tallyspark.operators import events as ev
from tallyspark.operators import identities, pricing, ranges, ranking, rollups
from tallyspark.sources import usage_view
from tallyspark.sources.files import Files
from tallyspark.sources.tables import UsageTables, write_csv
from tallyspark.streaming import ingest

from test_usage import HOUR, NOW, event, frame

SF = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_by_each_dialect(spark):
    decoded = ev.decode_usage(usage_view.record_json(usage_view.raw_usage(spark, SF)))
    assert 1 <= optimized(decoded).count("from_json") <= 3


def test_wrong_types_of_either_dialect_are_malformed(spark):
    rows = ['{"Detail": {"InputTokens": "many"}}', '{"Failed": "maybe"}', '{"Failure": {"StatusCode": [1]}}', '{"detail": {"input_tokens": "many"}}', '{"Provider": "p", "Detail": {"InputTokens": 3}}', "{}", None]
    got = ev.decode_usage(spark.createDataFrame(list(enumerate(rows)), "id long, raw string")).orderBy("id").collect()
    assert [r.malformed for r in got] == [True, True, True, True, False, False, True]


def test_spellings_of_the_base_url(spark):
    rows = [{"base_url": "https://a.example"}, {"baseURL": "https://b.example"}, {"BaseURL": "https://c.example"}, {"base_url": " ", "BaseURL": "https://d.example"}, {}]
    got = ev.decode_usage(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id long, raw string")).orderBy("id").collect()
    assert [r.base_url for r in got] == ["https://a.example", "https://b.example", "https://c.example", "https://d.example", ""]


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    t = UsageTables(spark, str(tmp_path_factory.mktemp("days")))
    t.write_batch(frame(spark, [event(NOW - d * 24 * HOUR - i, inputs=i, upstream_key=f"u{i % 2}") for d in range(6) for i in range(20)]), "a")
    t.write_batch(frame(spark, [event(NOW - i, inputs=1, upstream_key="u0") for i in range(10)]), "b")
    return t


def test_event_queries_prune_days(days):
    f = ev.EventFilter(from_ms=NOW - 26 * HOUR, to_ms=NOW)
    for df in (ev.filter_events(days.events(), f), ev.events_page(days.events(), f), ev.events_page_meta(days.events(), f), ev.export_events(days.events(), f)):
        filters = [line for line in plan(df, "formatted").splitlines() if "PartitionFilters" in line]
        assert filters and all("event_date" in line for line in filters)
    got = {(r.timestamp_ms, r.id) for r in ev.filter_events(days.events(), f).collect()}
    assert got == {(r.timestamp_ms, r.id) for r in days.events().collect() if f.from_ms <= r.timestamp_ms <= f.to_ms}


def test_several_dimensions_come_from_one_scan(spark, days):
    prices = usage_view.prices(spark)
    rng = ranges.time_range(NOW, "7d")
    for df, most in ((dims.distribution_stats(days.rollups(), prices, rng), 8), (dims.interface_stats(days.rollups(), prices, rng), 8)):
        text = plan(df)
        assert text.count("FileScan parquet") == 1 and text.count("Exchange") <= most
    one = {"models": "model", "providers": "provider", "api_keys": "api_key_hash"}
    rows = dims.distributions(days.rollups(), prices, rng).orderBy("rank_no").collect()
    for name, key in one.items():
        alone = dims.present(dims.dimension(days.rollups(), prices, rng, key)).orderBy("rank_no").collect()
        assert [(r.rank_no, r.requests, r.input_tokens, r.cost_usd, r.models) for r in rows if r.distribution == name] == [(r.rank_no, r.requests, r.input_tokens, r.cost_usd, r.models) for r in alone]
    merged = dims.present(dims.merged_sources(days.rollups(), prices, rng)).orderBy("rank_no").collect()
    assert [(r.rank_no, r.key, r.name, r.provider, r.requests, r.models) for r in rows if r.distribution == "sources"] == [(r.rank_no, r.key, r.name, r.provider, r.requests, r.models) for r in merged]


def test_partial_rollups_add_up_to_the_merged_ones(spark, days):
    rng = ranges.time_range(NOW, "7d")
    sums = lambda df: sorted(map(tuple, rollups.bucket_model(df, rng).collect()))
    assert sums(days.partial_rollups()) == sums(days.rollups()) == sums(rollups.minute_rollup(days.events()))
    assert days.partial_rollups().count() > days.rollups().count()


def test_a_lost_writer_leaves_the_old_state(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    t.write_batch(frame(spark, [event(NOW)]), "a")
    t.prune(30, NOW)
    before = t.state()
    # lost before the rename: the new file has no name yet
    t.files._write_new("state-1.json", {"generation": 9, "prices": 0, "horizon_ms": None})
    assert t.state() == before and t.events().count() == 1
    # lost after the new generation was written and before the state
    t.write_batch(t.events().drop("event_date"), "compacted", 1, True)
    assert t.state() == before and t.events().count() == 1
    t.compact()
    assert t.state()["generation"] == 1 and t.events().count() == 1 and t.state()["horizon_ms"] == before["horizon_ms"]
    for days in (29, 28, 27):
        t.prune(days, NOW)
    assert len(t.files.versions("state")) == 2 and t.state()["horizon_ms"] == NOW - 27 * 24 * HOUR


def test_two_writers_of_a_state(spark, tmp_path):
    a = Files(spark, str(tmp_path))
    a.advance("state", 1)
    a.advance("state", 2)
    assert a.latest("state") == 2 and a.versions("state") == [0, 1]


def raw(spark, n):
    return spark.createDataFrame([(json.dumps({"provider": "p", "model": "m", "requested_at_ms": NOW - i}),) for i in range(n)], "raw string")


def test_ids_of_late_batches(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    write = ingest.write_micro_batch(t, str(tmp_path / "dead"))
    for batch in (0, 2**21, 2**31 - 1):
        write(raw(spark, 7).repartition(3), batch)
    ids = [r.id for r in t.events().orderBy("id").collect()]
    assert len(set(ids)) == 21 and all(i >= 0 for i in ids) and [sum(i >> 32 == b for i in ids) for b in (0, 2**21, 2**31 - 1)] == [7, 7, 7]
    with pytest.raises(ValueError):
        ingest.batch_events(raw(spark, 1), 2**31, "s", NOW)


def test_failed_writes_are_counted(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    write = ingest.write_micro_batch(t, str(tmp_path / "dead"))
    write(raw(spark, 3), 0)
    with pytest.raises(Exception):  # noqa: B017
        write(raw(spark, 3).withColumn("raw", F.raise_error(F.lit("lost")).cast("string")), 1)
    facts = ingest.ingest_metrics(t)
    assert (facts["accepted"], facts["batches"], facts["write_failures"]) == (3, 1, 1)


def test_csv_export(spark, tmp_path):
    rows = frame(spark, [event(NOW, failed=True, failure='says "no", twice\nand ends'), event(NOW - 1, endpoint=" /v1 ", failure="")])
    out = ev.export_events(rows, ev.EventFilter())
    write_csv(out, str(tmp_path / "csv"))
    files = list(Path(tmp_path / "csv").glob("*.csv"))
    data = files[0].read_bytes()
    assert len(files) == 1 and data.startswith(b"\xef\xbb\xbftime,provider,")
    read = list(csv.DictReader(io.StringIO(data.decode("utf-8-sig"))))
    want = [{k: "" if v is None else str(v) for k, v in r.asDict().items()} for r in out.collect()]
    assert read == want and read[1]["failure"] == ""


def test_price_lists_are_bounded(spark):
    rows = spark.range(pricing.MOST_PRICES + 1).select(F.concat(F.lit("m"), "id").alias("model"), *[F.lit(1.0).alias(r) for r in ("input_per_million", "output_per_million", "cache_read_per_million", "cache_write_per_million", "reasoning_per_million")], F.lit(0).cast("long").alias("updated_at_ms"))
    with pytest.raises(ValueError, match="2000"):
        pricing.check_prices(rows)


def test_ranks_are_dealt_out(spark, days):
    prices, rng = usage_view.prices(spark), ranges.time_range(NOW, "7d")
    for df in (dims.interfaces(days.rollups(), prices, rng), dims.shares(dims.interfaces(days.rollups(), prices, rng)), dims.distributions(days.rollups(), prices, rng)):
        assert "Window" not in plan(df)
    rows = spark.range(5000).select((F.col("id") % 3).alias("kind"), (F.col("id") % 7).alias("size"), "id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("side"))
    got = ranking.ranked(rows, [F.desc("size"), F.col("id")], "rank_no").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank_no)] == [r.id for r in sorted(rows.collect(), key=lambda r: (-r.size, r.id))]
    assert sorted(r.rank_no for r in got) == list(range(1, 5001))
    for within in (("kind",), ("kind", "side")):
        got = ranking.ranked(rows, [F.desc("size"), F.col("id")], "rank_no", within).collect()
        groups = {}
        for r in got:
            groups.setdefault(tuple(r[w] for w in within), []).append(r)
        assert len(got) == 5000
        for own in groups.values():
            assert [(r.rank_no, r.id) for r in sorted(own, key=lambda r: r.rank_no)] == [(i + 1, r.id) for i, r in enumerate(sorted(own, key=lambda r: (-r.size, r.id)))]
    assert ranking.ranked(rows.limit(0), [F.col("id")], "rank_no").count() == 0


def test_a_batch_is_decoded_once(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    decoded = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            decoded.add(1)
            yield r

    lines = [(json.dumps({"provider": "p", "model": "m", "api_key": f"k{i % 3}", "requested_at_ms": NOW - i}),) for i in range(40)] + [("{",)] * 3
    rows = spark.createDataFrame(spark.sparkContext.parallelize(lines, 3).mapPartitions(seen), "raw string")
    write = ingest.write_micro_batch(t, str(tmp_path / "dead"))
    write(rows, 5)
    assert decoded.value == 43
    facts = ingest.ingest_metrics(t)
    assert (facts["accepted"], facts["dropped"], facts["batches"], facts["last_batch_events"]) == (40, 3, 1, 40)
    write(rows, 5)
    again = ingest.ingest_metrics(t)
    assert {k: again[k] for k in ("accepted", "dropped", "batches")} == {k: facts[k] for k in ("accepted", "dropped", "batches")}
    assert t.status()["events"] == 40 and spark.read.text(str(tmp_path / "dead/batch=5")).count() == 3


def test_a_replay_never_hides_its_batch(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    t.write_batch(frame(spark, [event(NOW), event(NOW - 1)]), "7")
    reader = t.events()
    with pytest.raises(Exception):  # noqa: B017
        t.write_batch(frame(spark, [event(NOW)]).withColumn("model", F.raise_error(F.lit("lost")).cast("string")), "7")
    assert t.events().count() == 2 and t.batches() == ["7"]
    for n in (3, 4):
        t.write_batch(frame(spark, [event(NOW - i) for i in range(n)]), "7")
        assert t.events().count() == n and t.rollups().agg(F.sum("requests")).first()[0] == n
        if n == 3:
            assert reader.count() == 2  # who was reading still reads what was there
    assert t.status()["events"] == 4 and len(t.files.names("gen-0/commits")) == 1 and len(t.files.names("gen-0/events")) == 2


def test_identities_are_worked_out_once(spark):
    rows = [(json.dumps({"provider": f" p{i % 2}", "model": "m ", "api_key": f"k{i % 3}", "auth_id": f"a{i % 2}", "source": ["", "ab", None][i % 3], "endpoint": "/v1/%2520a", "failure": {"body": " x\n"}, "requested_at_ms": NOW - i}),) for i in range(300)]
    decoded = ev.decode_usage(spark.createDataFrame(rows, "raw string").withColumn("id", F.monotonically_increasing_id())).drop("malformed")
    want = ev.normalize_events(ev.compact_events(decoded))
    for most in (200_000, 0):  # sent to all, and joined by shuffling
        seen = Observation()
        got = identities.by_distinct(decoded, {ev.RECORD_IDENTITY: lambda t: ev.record_identities(t.observe(seen, F.count(F.lit(1)).alias("n")), "s")}, most)  # noqa: B023
        assert got.count() == 300 and seen.get["n"] == 6
        assert ("BroadcastHashJoin" in plan(got)) == (most > 0)
    assert sorted(map(str, ev.stored_events(decoded).collect())) == sorted(map(str, want.collect()))


def test_the_listener_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(json.dumps({"provider": "p", "model": "m", "requested_at_ms": NOW - i}) for i in range(9)))
    listener = ingest.IngestListener()
    spark.streams.addListener(listener)
    try:
        t = UsageTables(spark, str(tmp_path / "t"))
        q = ingest.ingest_stream(ingest.record_stream(spark, str(tmp_path / "in")), t, str(tmp_path / "ck"), str(tmp_path / "dead"))
        q.awaitTermination(120)
        for _ in range(100):
            if not listener.queries.get(str(q.id), {"running": True})["running"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    own = listener.queries[str(q.id)]
    assert (own["batches"], own["records"], own["running"], own["error"]) == (1, 9, False, None)
