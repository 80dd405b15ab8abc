"""Schemas of events, rollups and prices."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()

EVENT = {
    "id": _L, "timestamp_ms": _L, "provider": _S, "executor_type": _S, "model": _S, "alias": _S, "endpoint": _S,
    "api_key_mask": _S, "api_key_hash": _S, "auth_id": _S, "auth_index": _S, "auth_type": _S, "upstream_key": _S,
    "upstream_label": _S, "source": _S, "reasoning_effort": _S, "service_tier": _S, "generate": _B, "latency_ms": _L,
    "ttft_ms": _L, "failed": _B, "status_code": T.IntegerType(), "failure": _S, "input_tokens": _L, "output_tokens": _L,
    "reasoning_tokens": _L, "cached_tokens": _L, "cache_read_tokens": _L, "cache_creation_tokens": _L, "total_tokens": _L,
}
EVENT_SCHEMA = T.StructType([T.StructField(k, v) for k, v in EVENT.items()])
EVENT_COLUMNS = tuple(EVENT)
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_read_tokens", "cache_creation_tokens", "total_tokens")
ROLLUP_KEYS = ("minute", "provider", "model", "source", "api_key_hash", "upstream_key")
ROLLUP_LABELS = ("api_key_mask", "upstream_label")
MEASURES = ("requests", "successes", "failures", *TOKENS, "latency_sum_ms", "ttft_sum_ms", "ttft_count")
#: Measures that a backup's events must not have below 0.
EVENT_MEASURES = ("latency_ms", "ttft_ms", *TOKENS)
RATES = ("input_per_million", "output_per_million", "cache_read_per_million", "cache_write_per_million", "reasoning_per_million")
PRICE_SCHEMA = T.StructType([T.StructField("model", _S), *[T.StructField(r, T.DoubleType()) for r in RATES], T.StructField("updated_at_ms", _L)])
BACKUP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("generated_at", _S),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField({"api_key_mask": "api_key"}.get(k, k), v) for k, v in EVENT.items()]))),
    T.StructField("prices", T.ArrayType(PRICE_SCHEMA)),
    T.StructField("truncated", _B),
])
