"""Usage records derived from the `events` test table, as raw columns and as JSON text in four dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import PASCAL
from .inputs import dealt
from .schema import PRICE_SCHEMA

MODELS = ("orion-4", "lyric-2", "hub/orion-4", "tarn", "open-1", "other-1")
#: 2024-01-31T00:00:00Z, the "now" of all queries on the test tables.
NOW_MS = 1_706_659_200_000
PRICES = (
    ("orion-4", 1.8, 7.2, 0.45, 2.25, 9.0, NOW_MS),
    ("lyric-2", 2.6, 13.0, 0.0, 0.0, 0.0, NOW_MS),
    ("open-1", 0.0, 0.0, 0.0, 0.0, 0.0, NOW_MS),
    ("*", 1.0, 2.0, 0.1, 0.0, 0.0, NOW_MS),
)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_SCHEMA)


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw usage record per row of `events`."""
    e = dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_id", "ts", "user_id"])
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, i, u = F.col("k"), F.col("event_id"), F.col("user_id")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (k % 6 + 1).cast("int"))
    half = F.expr("(event_id % 1000) div 2")
    auth_id = F.concat(F.lit("account-"), (u % 20).cast("string"), F.lit("@example.com"))
    failed = F.col("event_type") == "error"
    return e.select(
        i.alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.concat(F.lit("prov-"), (u % 4).cast("string")).alias("provider"),
        model.alias("model"),
        F.when(k % 3 == 0, "https://api.example.com/v1/chat%20x/completions?key=1#f").when(k % 3 == 1, "/v1/messages").otherwise("").alias("endpoint"),
        F.when(i % 5 == 0, F.concat(F.lit("team · "), auth_id)).when(i % 5 == 1, "unknown").otherwise("").alias("source"),
        F.concat(F.lit("sk-client-"), u.cast("string"), F.lit("-key")).alias("api_key"),
        auth_id.alias("auth_id"),
        (u % 20).cast("string").alias("auth_index"),
        F.when(u % 2 == 0, "oauth").otherwise("apikey").alias("auth_type"),
        (k % 2 == 0).alias("generate"),
        failed.alias("failed"),
        F.when(failed, 429).otherwise(0).cast("int").alias("status_code"),
        F.when(failed, "rate limited").otherwise("").alias("failure"),
        (50 + (i * 37) % 5000).alias("latency_ms"),
        F.when(k % 4 == 0, 0).otherwise(10 + (i * 13) % 900).cast("long").alias("ttft_ms"),
        (10 + i % 1000 + 10 * k).alias("input_tokens"),
        (5 + i % 300 + k).alias("output_tokens"),
        F.when(k % 2 == 0, F.expr("(event_id % 300) div 4")).otherwise(0).cast("long").alias("reasoning_tokens"),
        F.when(k % 3 == 0, half).otherwise(0).cast("long").alias("cached_tokens"),
        F.when(k % 6 == 0, half).otherwise(0).cast("long").alias("cache_read_tokens"),
        F.when(k % 5 == 0, k).otherwise(0).cast("long").alias("cache_creation_tokens"),
        F.when(i % 7 == 0, 0).otherwise(15 + i % 1000 + 10 * k + i % 300 + k).cast("long").alias("total_tokens"),
    )


def record_json(raw: DataFrame) -> DataFrame:
    """id and the record as JSON text, in the dialect id % 4."""
    c = F.col
    time = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    names = ("provider", "model", "endpoint", "source", "api_key", "auth_id", "auth_index", "auth_type")
    tokens = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_read_tokens", "cache_creation_tokens", "total_tokens")
    title = lambda n: n.title().replace("_", "")
    plain = F.struct(
        *[c(n) for n in names], time.alias("requested_at"), (c("latency_ms") * 1_000_000).alias("latency"), (c("ttft_ms") * 1_000_000).alias("ttft"), "generate", "failed",
        F.struct("status_code", c("failure").alias("body")).alias("failure"), F.struct(*tokens).alias("detail"),
    )
    pascal = F.struct(
        *[c(n).alias(PASCAL[n]) for n in names], c("timestamp_ms").alias("RequestedAtMs"), F.concat(c("latency_ms").cast("string"), F.lit("ms")).alias("Latency"), c("ttft_ms").alias("TTFTMs"),
        c("generate").alias("Generate"), c("failed").alias("Failed"), F.struct(c("status_code").alias("StatusCode"), c("failure").alias("Body")).alias("Failure"),
        F.struct(*[c(n).alias(title(n)) for n in tokens]).alias("Detail"),
    )
    # prompt/completion spellings know one cached count, which stands for cache reads too
    prompt = F.struct(
        *[c(n) for n in names], F.concat((c("timestamp_ms") / 1000).cast("decimal(20,3)").cast("string"), F.lit("4")).alias("requested_at"), c("latency_ms"), F.concat((c("ttft_ms") / 1000).cast("decimal(20,3)").cast("string"), F.lit("s")).alias("ttft"),
        c("generate").alias("streaming"), "failed", F.struct("status_code", c("failure").alias("body")).alias("failure"),
        F.struct(
            c("input_tokens").alias("prompt_tokens"), c("output_tokens").alias("completion_tokens"), F.struct(c("cached_tokens").alias("cached_tokens"), c("cache_creation_tokens").alias("cache_write_tokens")).alias("prompt_tokens_details"),
            F.struct("reasoning_tokens").alias("completion_tokens_details"), "total_tokens",
        ).alias("detail"),
    )
    inputs = F.struct(
        *[c(n) for n in names], c("timestamp_ms").alias("requested_at_ms"), F.concat(c("latency_ms").cast("string"), F.lit("000us")).alias("latency"), c("ttft_ms"),
        c("generate").alias("Generate"), c("failed").alias("Failed"), F.struct("status_code", c("failure").alias("body")).alias("failure"),
        F.struct("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", c("cache_read_tokens").alias("cache_read_input_tokens"), c("cache_creation_tokens").alias("cache_creation_input_tokens"), "total_tokens").alias("detail"),
    )
    dialect = c("id") % 4
    text = F.when(dialect == 0, F.to_json(plain)).when(dialect == 1, F.to_json(pascal)).when(dialect == 2, F.to_json(prompt)).otherwise(F.to_json(inputs))
    return raw.select("id", text.alias("raw"))
