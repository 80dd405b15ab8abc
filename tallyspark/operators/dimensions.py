"""Statistics by dimension: models, providers, API keys, sources, upstreams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.text import ratio
from ..sources.schema import TOKENS
from .pricing import with_costs
from .ranges import TimeRange
from .ranking import ranked
from .rollups import rollups_in
from .trends import COST_DIGITS, rounded

#: Key and label columns of the dimensions.
DIMENSIONS = {"model": "model", "provider": "provider", "api_key_hash": "api_key_mask", "source": "source", "upstream_key": "upstream_label"}
LABELS = {"api_keys": "api_key_hash", "models": "model", "providers": "provider", "sources": "source", "upstreams": "upstream_key"}
SUMS = ("requests", "successes", "failures", *TOKENS, "latency_sum_ms")
SHOWN = ("requests", "successes", "failures", *TOKENS)


def level_one(rollups: DataFrame, rng: TimeRange, key: str, **equal: str) -> DataFrame:
    """Sums by key, provider and model with the largest label."""
    if key not in DIMENSIONS or any(k not in (*DIMENSIONS, *DIMENSIONS.values()) for k in equal):
        raise ValueError(f"no statistics by {key}")
    rows = _added(rollups_in(rollups, rng, **equal).select(F.col(key).alias("key"), "provider", "model", F.col(DIMENSIONS[key]).alias("label"), *SUMS), "key", "provider", "model", "label")
    return _labelled(rows, "key", "provider", "model")


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """rows added up by some columns: sums alone, which are added up where the rows are and need no sorting (a largest text would)."""
    return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in SUMS])


def _labelled(added: DataFrame, *by: str) -> DataFrame:
    """Sums by key and label as sums by key with the largest label."""
    return added.groupBy(*by).agg(F.max("label").alias("label"), *[F.sum(m).alias(m) for m in SUMS])


def level_one_by(rollups: DataFrame, rng: TimeRange, keys: dict[str, str]) -> DataFrame:
    """The same of several dimensions (kind: key) from one scan, with their kinds: each row is counted once for each before the shuffle."""
    each = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(DIMENSIONS[key]).alias("label")) for kind, key in keys.items()]))
    rows = _added(rollups_in(rollups, rng).select(each, "provider", "model", *SUMS), "kind", "key", "provider", "model", "label")
    return _labelled(rows, "kind", "key", "provider", "model")


def level_two(costed: DataFrame, by: list[str]) -> DataFrame:
    """Level-one rows with costs, added up by `by`; the name is the label of the first provider and model."""
    first = F.struct("provider", "model")
    keep = [F.min_by(x, first).alias(y) for x, y in (("label", "name"), ("provider", "provider")) if y not in by]
    return costed.groupBy(*by).agg(*keep, *[F.sum(m).alias(m) for m in SUMS], F.sum("cost_usd").alias("cost_usd"), F.count_distinct("model").alias("models"))


def dimension(rollups: DataFrame, prices: DataFrame, rng: TimeRange, key: str, **equal: str) -> DataFrame:
    """Unrounded statistics of a dimension: key, name, provider, sums, cost_usd, models. Sources are told apart by provider."""
    costed = with_costs(level_one(rollups, rng, key, **equal), prices)
    return level_two(costed, ["key", "provider"] if key == "source" else ["key"])


def present(stats: DataFrame, *within: str) -> DataFrame:
    """Ranked (within some columns) by requests, then stored name, then key; rounded rates."""
    stats = ranked(stats, [F.desc("requests"), F.col("name"), F.col("key"), F.col("provider")], "rank_no", within)
    rate, latency = ratio(F.col("successes"), F.col("requests")), ratio(F.col("latency_sum_ms"), F.col("requests"))
    return stats.select(
        *within, F.col("rank_no").cast("int").alias("rank_no"), "key", "name", "provider", *SHOWN, rounded(F.col("cost_usd"), COST_DIGITS).alias("cost_usd"),
        rounded(rate).alias("success_rate"), rounded(latency).alias("avg_latency_ms"), "models",
    )


def merged_sources(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """Sources by provider and masked name, as several may look the same when masked; public keys."""
    costed = with_costs(level_one(rollups, rng, "source"), prices)
    masked = costed.withColumn("name", ids.masked_label(F.col("provider"), F.col("label"), F.col("key")))
    merged = masked.groupBy("provider", "name").agg(*[F.sum(m).alias(m) for m in SUMS], F.sum("cost_usd").alias("cost_usd"), F.count_distinct("model").alias("models"))
    return merged.withColumn("key", ids.public_identifier("source", F.concat_ws("\0", "provider", "name")))


def distribution_stats(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """Unrounded statistics of models, providers, API keys and merged sources in one long table with a `distribution` column, from one scan."""
    keys = {"models": "model", "providers": "provider", "api_keys": "api_key_hash", "sources": "source"}
    costed = with_costs(level_one_by(rollups, rng, keys), prices)
    source = F.col("kind") == "sources"
    # sources are told apart by provider and masked name, as in merged_sources
    group = F.when(source, ids.masked_label(F.col("provider"), F.col("label"), F.col("key"))).otherwise(F.col("key"))
    stats = level_two(costed.withColumns({"group": group, "owner": F.when(source, F.col("provider"))}), ["kind", "group", "owner"])
    key = F.when(source, ids.public_identifier("source", F.concat_ws("\0", "owner", "group"))).otherwise(F.col("group"))
    stats = stats.withColumns({"key": key, "name": F.when(source, F.col("group")).otherwise(F.col("name")), "provider": F.coalesce("owner", "provider")})
    return stats.withColumnRenamed("kind", "distribution")


def distributions(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """The same ranked within each distribution, as displayed."""
    return _shown(present(distribution_stats(rollups, prices, rng), "distribution"), "distribution")


def interface_stats(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """Unrounded statistics of API keys and upstreams in one long table with a `kind` column, from one scan."""
    costed = with_costs(level_one_by(rollups, rng, {"api_keys": "api_key_hash", "upstreams": "upstream_key"}), prices)
    return level_two(costed, ["kind", "key"])


def interfaces(rollups: DataFrame, prices: DataFrame, rng: TimeRange) -> DataFrame:
    """The same ranked within each kind, as displayed."""
    return _shown(present(interface_stats(rollups, prices, rng), "kind"), "kind")


def _shown(rows: DataFrame, kind: str) -> DataFrame:
    """Presented API keys and upstreams as they are displayed: ranks keep the stored order."""
    c = F.col
    public = F.when(c(kind) == "api_keys", ids.public_identifier("key", c("key")))
    masked = F.when(c(kind) == "upstreams", ids.masked_label(c("provider"), c("name"), c("key")))
    return rows.withColumns({"name": F.coalesce(public, masked, c("name")), "key": F.coalesce(public, c("key"))})


def analysis_tokens(models: DataFrame) -> DataFrame:
    """Token totals over the model statistics."""
    return models.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS])


def upstream_summary(rollups: DataFrame, prices: DataFrame, rng: TimeRange, key: str) -> DataFrame:
    """One row on an upstream: display name, sums over its models, rates from exact sums."""
    if not key.strip() or len(key.encode()) > 160:
        raise ValueError("name an upstream by its key")
    models = dimension(rollups, prices, rng, "model", upstream_key=key)
    sums = models.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in SUMS], F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    names = rollups_in(rollups, rng, upstream_key=key).agg(F.max("source").alias("_source"), F.max("provider").alias("_provider"))
    rate, latency = ratio(F.col("successes"), F.col("requests")), ratio(F.col("latency_sum_ms"), F.col("requests"))
    return sums.join(F.broadcast(names)).select(  # two single rows
        F.lit(key).alias("key"), ids.masked_label(F.col("_provider"), F.col("_source"), F.lit(key)).alias("name"), *SHOWN,
        rounded(F.col("cost_usd"), COST_DIGITS).alias("cost_usd"), rounded(rate).alias("success_rate"), rounded(latency).alias("avg_latency_ms"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """key, requests and percent of all requests, at most 100."""
    total = stats.agg(F.sum("requests").alias("_total"))
    percent = ratio(F.col("requests") * 100, F.col("_total"))
    return stats.join(F.broadcast(total)).select("key", "requests", rounded(F.least(F.lit(100.0), percent)).alias("percent"))  # one row


def top_five(rows: DataFrame) -> DataFrame:
    """The five largest of each distribution with their percent of the five."""
    top = rows.where((F.col("rank_no") <= 5) & (F.col("requests") > 0))
    total = F.sum("requests").over(Window.partitionBy("distribution"))
    return top.select("distribution", "rank_no", "name", "requests", F.round(ratio(F.col("requests") * 100, total), 1).alias("percent"))


def status_bands(stats: DataFrame) -> DataFrame:
    rate = F.col("success_rate")
    band: Column = F.when(rate >= 0.98, "online").when(rate >= 0.9, "unsteady").otherwise("attention")
    return stats.select("key", "name", "success_rate", band.alias("status"))


def interface_summary(rows: DataFrame) -> DataFrame:
    """One row on the interfaces table: active keys, upstreams, requests, weighted latency, healthy upstreams."""
    up = F.col("kind") == "upstreams"
    weighted = F.sum(F.when(up, F.col("avg_latency_ms") * F.col("requests")))
    out = rows.agg(
        F.count_if(~up).alias("active_keys"), F.count_if(up).alias("upstreams"), F.coalesce(F.sum(F.when(up, F.col("requests"))), F.lit(0)).alias("requests"),
        F.coalesce(weighted, F.lit(0.0)).alias("_w"), F.count_if(up & (F.col("success_rate") >= 0.9)).alias("healthy"),
    )
    return out.select("active_keys", "upstreams", "requests", F.round(ratio(F.col("_w"), F.col("requests")), 3).alias("avg_latency_ms"), "healthy")


def filter_options(rows: DataFrame) -> DataFrame:
    """Providers and models to choose from."""
    return rows.where(F.col("distribution").isin("models", "providers")).select("distribution", "key", "name").distinct()
