"""Plans of usage queries on tables far larger than the tests': how work is dealt out and what is shuffled."""

from pyspark.sql import functions as F

from tallyspark.operators import dimensions as dims
from tallyspark.operators import events as ev
from tallyspark.operators import identities, ranges
from tallyspark.plans import queries
from tallyspark.sources import usage_view
from tallyspark.sources.tables import UsageTables

from test_usage import HOUR, NOW, event, frame
from test_usage_plans import optimized, plan

SF = "/root/testdata/sf0.001"


def test_malformed_records_are_parsed_once_in_the_tasks_they_are_dealt_to(spark):
    got = queries.malformed(spark, SF)
    text = optimized(got)
    assert text.count("from_json") == 2  # once for each dialect
    filtered, dealt = text.index("Filter malformed"), text.index("Repartition")
    assert filtered < text.index("from_json") < dealt  # a plan is printed from its last step
    ids = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    assert sorted(r.id for r in got.collect()) == sorted(i for i in ids if i % 11 in (0, 1, 2))


def test_records_are_dealt_to_more_tasks_the_more_there_are(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    many = -(-1_000_000 // events.count())
    events.join(spark.range(many).withColumnRenamed("id", "_copy")).withColumn("event_id", F.col("event_id") + 100_000 * F.col("_copy")).drop("_copy").write.parquet(f"{tmp_path}/events.parquet")
    raw = usage_view.raw_usage(spark, str(tmp_path))
    sizes = [r.n for r in raw.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 10 and max(sizes) < 150_000 and sum(sizes) >= 1_000_000


def test_a_batch_is_dealt_once_for_its_minutes_and_once_for_its_tiers(spark, tmp_path, monkeypatch):
    def nodes(df, name):
        return [x for x in plan(df).splitlines() if name in x]

    written, add = [], UsageTables._by_day
    monkeypatch.setattr(UsageTables, "_by_day", lambda *a: written.append(add(*a)) or written[-1])
    t = UsageTables(spark, str(tmp_path / "t"))
    t.write_batch(frame(spark, [event(NOW - i * HOUR, inputs=i, upstream_key=f"u{i % 3}") for i in range(60)]), "a")
    assert [len(nodes(df, "Exchange")) for df in written] == [1, 1]
    assert t.rollups().count() == 60 and not nodes(t.rollups(), "Aggregate")  # a batch alone is not merged
    t.write_batch(frame(spark, [event(NOW, inputs=1, upstream_key="u0")]), "b")
    assert t.rollups().count() == 60 and nodes(t.rollups(), "Aggregate")


def test_many_clients_are_not_shuffled_to_be_named(spark, monkeypatch):
    monkeypatch.setattr(identities.by_distinct, "__defaults__", (20,))
    rows = spark.range(500).select("id", F.concat(F.lit("sk-"), "id").alias("api_key"), F.lit("p").alias("provider"), F.lit("/v1").alias("endpoint"), F.lit("m").alias("model"))
    decoded = ev.decode_usage(rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "id"])).alias("raw"))).drop("malformed")
    stored = ev.stored_events(decoded)
    assert "SortMergeJoin" not in plan(stored)
    assert sorted(map(str, stored.drop("timestamp_ms").collect())) == sorted(map(str, ev.normalize_events(ev.compact_events(decoded)).drop("timestamp_ms").collect()))


def test_sums_are_hashed_before_labels_are_compared(spark, tmp_path):
    t = UsageTables(spark, str(tmp_path / "t"))
    t.write_batch(frame(spark, [event(NOW - i, inputs=i, upstream_key=f"u{i % 3}") for i in range(60)]), "a")
    for rows in (dims.level_one(t.rollups(), ranges.time_range(NOW), "source"), dims.level_one_by(t.rollups(), ranges.time_range(NOW), {"models": "model", "api_keys": "api_key_hash"})):
        text = plan(rows)
        assert text.rindex("HashAggregate") > text.rindex("SortAggregate")  # nearest to the scan
        assert sum(r.requests for r in rows.collect()) in (60, 120)
