"""The registered queries on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, identity, text
from ..operators import dimensions as dims
from ..operators import events as ev
from ..operators import pricing, rollups, trends
from ..operators.ranges import health_range, time_range
from ..sources import usage_view
from ..sources.schema import EVENT_COLUMNS, RATES, TOKENS
from ..sources.usage_store import usage_records, usage_store
from ..sources.usage_view import NOW_MS
from .oracles import CUSTOM, RANGE_30D_NOW

R24, R7, R30, ALL = (time_range(NOW_MS, x) for x in ("24h", "7d", "30d", "all"))
R30_EARLIER = time_range(RANGE_30D_NOW, "30d")
R_HEALTH = health_range(NOW_MS)
R_CUSTOM = time_range(NOW_MS, "custom", *CUSTOM)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they are stored."""
    return usage_store(spark, sf_dir).events().select(*EVENT_COLUMNS)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their days, on which conditions prune folders."""
    return usage_store(spark, sf_dir).events()


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollups of each batch, for queries that add them up."""
    return usage_store(spark, sf_dir).partial_rollups()


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollups."""
    return usage_store(spark, sf_dir).rollups()


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.decode_usage(usage_view.record_json(usage_view.raw_usage(spark, sf_dir)))


def upstream_key() -> str:
    import hashlib
    import hmac

    return hmac.new(identity.SALT.encode(), b"\0".join([b"prov-1", b"account-5@example.com", b"5", b"apikey"]), hashlib.sha256).hexdigest()[:16]


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage_view.raw_usage(spark, sf_dir)
    at, kind = F.col("timestamp_ms"), F.col("id") % 6
    stamp = F.timestamp_millis("timestamp_ms")
    raw = (
        F.when(kind == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(kind == 1, F.expr("cast(timestamp_ms div 1000 as string)"))
        .when(kind == 2, at.cast("string"))
        .when(kind == 3, F.concat(at.cast("string"), F.lit("400000")))
        .when(kind == 4, F.concat(F.date_format(stamp + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+08:00")))
        .otherwise("not a time")
    )
    return decode.event_time_ms(u.select("id", raw.alias("v")), "v", "time_ms").drop("v")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage_view.raw_usage(spark, sf_dir)
    n, kind = F.col("latency_ms").cast("string"), F.col("id") % 6
    raw = (
        F.when(kind == 0, F.concat(n, F.lit("ms")))
        .when(kind == 1, n)
        .when(kind == 2, F.concat(F.lit("1h2m3.5s"), n, F.lit("us")))
        .when(kind == 3, F.concat(F.lit("-"), n, F.lit("s")))
        .when(kind == 4, F.concat(n, F.lit(".5")))
        .otherwise("5 parsecs")
    )
    return decode.duration_ns(u.select("id", raw.alias("v")), "v", 1_000_000, "duration_ns").drop("v")


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = usage_view.record_json(usage_view.raw_usage(spark, sf_dir))
    kind = F.col("id") % 11
    broken = F.when(kind == 0, F.expr("left(raw, length(raw) - 1)")).when(kind == 1, "not json").when(kind == 2, F.concat(F.lit("["), "raw", F.lit("]"))).otherwise(F.col("raw"))
    return ev.malformed_records(records.withColumn("raw", broken)).select("id")


def customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    value = (
        F.when(k % 6 == 0, F.concat(n, F.lit(".json")))
        .when(k % 6 == 1, F.left(n, (k % 9).cast("int")))
        .when(k % 6 == 2, F.concat(F.lit("  "), n, F.lit(".yaml.json ")))
        .when(k % 6 == 3, F.concat(n, F.lit("@x.example")))
        .when(k % 6 == 4, "")
        .otherwise(k.cast("string"))
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", value.alias("v"))


def dirty_values(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("  "), n, F.lit("\n")))
        .when(k % 4 == 1, F.repeat(F.concat(n, F.lit("\t")), F.lit(times)))
        .when(k % 4 == 2, " \t")
        .otherwise(F.concat(n, F.lit("\x7f"), "c_mktsegment"))
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", value.alias("v"))


def legacy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage_view.raw_usage(spark, sf_dir)
    kind = F.col("id") % 3
    label = F.when(kind == 0, F.concat("provider", F.lit(" · "), "auth_id", F.lit(".json"))).when(kind == 1, F.concat(F.lit("team / "), "auth_id")).otherwise(F.concat("provider", F.lit(" / abc***yz")))
    owner = F.when(kind == 1, "").otherwise(F.col("provider"))
    return u.select("id", identity.masked_label(owner, label, F.lit("f")).alias("label"))


def submitted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 90 == 7, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("-"), (k % 1500).cast("string"), F.lit(" ")))
    rates = {r: F.lit(0.0) for r in RATES} | {"input_per_million": F.when(k % 50 == 0, -1.0).otherwise(F.col("p_retailprice") / 100), "output_per_million": F.when(k % 77 == 0, 2e6).otherwise(0.5)}
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("model"), *[v.alias(r) for r, v in rates.items()])


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("model"))
    return parts.agg((F.min("p_retailprice") / 100).alias("input_per_million"), (F.max("p_retailprice") / 100).alias("output_per_million"))


def split_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups merged from partial ones of three batches."""
    events = stored(spark, sf_dir).withColumn("batch_id", F.col("id") % 3)
    parts = None
    for b in range(3):
        own = rollups.minute_rollup(events.where(F.col("batch_id") == b)).withColumn("batch_id", F.lit(b))
        parts = own if parts is None else parts.unionByName(own)
    return rollups.merge_rollups(parts)


def backup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(spark, sf_dir)
    return e.withColumns({"ordinal": F.col("id") + 1, "model": F.when(F.col("id") % 1009 == 7, " ").otherwise(F.col("model")), "latency_ms": F.when(F.col("id") % 97 == 5, -1).otherwise(F.col("latency_ms"))})


def model_sums(r: DataFrame) -> DataFrame:
    return r.groupBy("model").agg(*[F.sum(m).alias(m) for m in dims.SUMS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    prices = usage_view.prices
    on_rollups = lambda f: lambda s, d: f(rolled(s, d), prices(s))
    on_sums = lambda f: lambda s, d: f(added(s, d), prices(s))
    # what adds up a range, from the tiers that fit buckets of its interval, or any tier if it is added up as a whole
    in_buckets = lambda rng, f: lambda s, d: f(usage_store(s, d).sums(rng, rng.interval), prices(s))
    as_whole = lambda rng, f: lambda s, d: f(usage_store(s, d).sums(rng), prices(s))
    paged = lambda f: lambda s, d: usage_store(s, d).page(f)
    on_dated = lambda f: lambda s, d: f(dated(s, d))
    on_events = lambda f: lambda s, d: f(stored(s, d))
    page = ev.EventFilter(from_ms=R7.from_ms, to_ms=R7.to_ms, provider="prov-1", page=3, page_size=25)
    narrow = ev.EventFilter(from_ms=R30.from_ms, to_ms=R30.to_ms, model="tarn", provider="prov-1", status="failure", upstream_key=upstream_key())
    recent = ev.EventFilter(from_ms=R30.from_ms, to_ms=R30.to_ms, upstream_key=upstream_key(), page_size=20)
    # labels of API keys and upstreams are those of the latest batch; the others are keys themselves
    merged = lambda key: on_rollups if key in ("api_key_hash", "upstream_key") else lambda f: as_whole(R30, f)
    dimension = lambda key, **equal: merged(key)(lambda r, p: dims.present(dims.dimension(r, p, R30, key, **equal)))
    kinds = lambda kind: on_rollups(lambda r, p: dims.interfaces(r, p, R30).where(F.col("kind") == kind))
    of = lambda f, g: lambda s, d: f(g(s, d))
    token_names = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_write", "reasoning_tokens": "reasoning"}
    tokens = as_whole(R30, lambda r, p: dims.analysis_tokens(dims.dimension(r, p, R30, "model")))
    return {
        "summary_kpi": in_buckets(R30, lambda r, p: trends.summary_kpi(r, p, R30)),
        "range_24h": in_buckets(R24, lambda r, p: trends.summary_kpi(r, p, R24)),
        "range_7d": in_buckets(R7, lambda r, p: trends.summary_kpi(r, p, R7)),
        "range_30d": in_buckets(R30_EARLIER, lambda r, p: trends.summary_kpi(r, p, R30_EARLIER)),
        "range_all": in_buckets(ALL, lambda r, p: trends.summary_kpi(r, p, ALL)),
        "range_custom": in_buckets(R_CUSTOM, lambda r, p: trends.summary_kpi(r, p, R_CUSTOM)),
        "decode_usage": lambda s, d: decoded(s, d).select(
            "id", "provider", "model", "endpoint", "source", "api_key", "auth_id", "auth_index", "auth_type", (F.col("generate") | F.col("stream")).alias("streamed"), "failed", "requested_at_ms", "latency_ns", "ttft_ns"
        ),
        "decode_failure": lambda s, d: decoded(s, d).select("id", "status_code", "failure"),
        "decode_token_detail": lambda s, d: decoded(s, d).select("id", *TOKENS),
        "parse_event_time": event_times,
        "parse_duration": durations,
        "malformed_records": malformed,
        "compact_events": lambda s, d: ev.compact_events(usage_records(s, d)),
        "normalize_events": lambda s, d: ev.stored_events(usage_records(s, d)),
        "redacted_events": on_events(ev.redact_events),
        "uncached_input": on_events(ev.uncached_input),
        "minute_rollup": on_events(rollups.minute_rollup),
        "merge_rollups": split_rollups,
        "bucket_model_aggregate": in_buckets(R30, lambda r, p: rollups.bucket_model(r, R30)),
        "price_list": of(pricing.price_list, part_prices),
        "validate_prices": lambda s, d: pricing.validate_prices(submitted_prices(s, d)).select("p_partkey", "model", "reason"),
        "price_resolution": on_sums(lambda r, p: pricing.resolve_prices(model_sums(r), p).select("model", "price_match", *RATES)),
        "cost_by_model": on_sums(lambda r, p: pricing.with_costs(model_sums(r), p).select("model", F.round("cost_usd", 9).alias("cost_usd"))),
        "standard_cost": on_sums(lambda r, p: pricing.with_costs(model_sums(r), p).select("model", F.round("standard_cost_usd", 9).alias("standard_cost_usd"))),
        "export_events": lambda s, d: usage_store(s, d).export(ev.EventFilter(status="failure")),
        "backup_events": on_events(lambda e: ev.backup_events(e)),
        "validate_backup": of(ev.validate_backup, backup_candidates),
        "retention_events": on_events(lambda e: rollups.surviving_events(e, 10, NOW_MS).select("id")),
        "retention_rollups": on_sums(lambda r, p: rollups.surviving_rollups(r, 10, NOW_MS).groupBy("minute").agg(F.sum("requests").alias("requests"))),
        "table_status": lambda s, d: rollups.table_status(stored(s, d), rolled(s, d)),
        "hmac_pseudonym": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", identity.short_hmac(F.col("c_name"), identity.SALT).alias("pseudonym")),
        "public_identifier": lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", identity.public_identifier("key", F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name"))).alias("public_id")),
        "mask_credential": lambda s, d: customer_values(s, d).select("c_custkey", identity.mask_credential(F.col("v")).alias("masked")),
        "clean_dimension": lambda s, d: dirty_values(s, d, 12).select("c_custkey", text.clean_dimension(F.col("v"), "none").alias("cleaned")),
        "sanitize_failure": lambda s, d: dirty_values(s, d, 40).select("c_custkey", text.sanitize_failure(F.col("v")).alias("cleaned")),
        "sanitize_endpoint": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.sanitize_endpoint(F.col("url")).alias("path")),
        "masked_upstream_label": legacy_labels,
        "filter_events": on_dated(lambda e: ev.filter_events(e, narrow).select(*EVENT_COLUMNS)),
        "search_events": on_events(lambda e: ev.filter_events(e, ev.EventFilter(search="ORION_4")).select("id")),
        "events_page": paged(page),
        "events_page_newest": paged(ev.EventFilter()),
        "events_page_deep": paged(ev.EventFilter(status="failure", page=30)),
        "events_page_meta": on_dated(lambda e: ev.events_page_meta(e, page)),
        "upstream_recent_events": paged(recent),
        "trend": in_buckets(R30, lambda r, p: trends.trend(r, p, R30)),
        "trend_dense": in_buckets(R24, lambda r, p: trends.trend_dense(r, p, R24).select(F.lit("24h").alias("range_label"), "*")),
        "trend_dense_custom": in_buckets(R_CUSTOM, lambda r, p: trends.trend_dense(r, p, R_CUSTOM)),
        "trend_nonempty": in_buckets(R_CUSTOM, lambda r, p: trends.trend_nonempty(trends.trend_dense(r, p, R_CUSTOM))),
        "sparkline": in_buckets(R24, lambda r, p: trends.sparkline(trends.trend_dense(r, p, R24), "requests")),
        "health_grid": in_buckets(R_HEALTH, lambda r, p: trends.health_grid(r, NOW_MS)),
        "health_levels": in_buckets(R_HEALTH, lambda r, p: trends.health_levels(trends.health_grid(r, NOW_MS))),
        "health_totals": in_buckets(R_HEALTH, lambda r, p: trends.health_totals(trends.health_grid(r, NOW_MS))),
        "dimension_level1": on_rollups(lambda r, p: dims.level_one(r, R30, "upstream_key")),
        "dim_model": dimension("model"),
        "dim_provider": dimension("provider"),
        "dim_api_key": dimension("api_key_hash"),
        "dim_source": dimension("source"),
        "dim_upstream": dimension("upstream_key"),
        "dim_source_merged": as_whole(R30, lambda r, p: dims.present(dims.merged_sources(r, p, R30))),
        "analysis_distributions": on_rollups(lambda r, p: dims.distributions(r, p, R30)),
        "analysis_tokens": tokens,
        "token_composition": lambda s, d: trends.token_composition(tokens(s, d).select(*[F.col(k).alias(v) for k, v in token_names.items()])),
        "distribution_top5": on_rollups(lambda r, p: dims.top_five(dims.distributions(r, p, R30))),
        "filter_options": on_rollups(lambda r, p: dims.filter_options(dims.distributions(r, p, R30))),
        "interfaces": on_rollups(lambda r, p: dims.interfaces(r, p, R30)),
        "interface_summary": on_rollups(lambda r, p: dims.interface_summary(dims.interfaces(r, p, R30))),
        "api_key_share": of(dims.shares, kinds("api_keys")),
        "upstream_share": of(dims.shares, kinds("upstreams")),
        "upstream_status": of(dims.status_bands, kinds("upstreams")),
        "upstream_detail_models": dimension("model", upstream_key=upstream_key()),
        "upstream_summary": as_whole(R30, lambda r, p: dims.upstream_summary(r, p, R30, upstream_key())),
    }
