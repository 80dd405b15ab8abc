"""DuckDB SQL of the registered queries on the test tables, built from shared parts."""

from __future__ import annotations

from ..functions.identity import PUBLIC_SALT, SALT, pads
from ..operators.ranges import TimeRange, health_range, time_range
from ..sources.schema import MEASURES, RATES, TOKENS
from ..sources.usage_view import MODELS, NOW_MS, PRICES

SUMS = ("requests", "successes", "failures", *TOKENS, "latency_sum_ms")
#: "now" of range_30d: half a day before that of the others.
RANGE_30D_NOW = NOW_MS - 43_200_000
CUSTOM = ("2024-01-10T00:00:00Z", "2024-01-10T08:00:00Z")


def hmac(blob: str, salt: str = SALT) -> str:
    inner, outer = pads(salt)
    return f"left(sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {blob}))), 16)"


def joined(*texts: str) -> str:
    return " || '\\x00'::BLOB || ".join(f"encode({t})" for t in texts)


def mask(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 'unknown' WHEN length({x}) >= 6 THEN left({x}, 3) || '***' || right({x}, 2) WHEN length({x}) >= 3 THEN left({x}, 1) || '***' || right({x}, 1) ELSE left({x}, 1) || '***' END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / {b} END"


def sums(names=SUMS, empty: bool = False) -> str:
    return ", ".join(f"coalesce(sum({m}), 0)::BIGINT AS {m}" if empty else f"sum({m})::BIGINT AS {m}" for m in names)


_MODEL = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"
RAW = f"""
u0 AS (SELECT event_id AS i, user_id AS u, event_type, ts, json_extract(props, '$.k')::BIGINT AS k FROM events),
u AS (SELECT i AS id, epoch_us(ts) // 1000 AS timestamp_ms, 'prov-' || (u % 4) AS provider, {_MODEL} AS model,
  CASE k % 3 WHEN 0 THEN 'https://api.example.com/v1/chat%20x/completions?key=1#f' WHEN 1 THEN '/v1/messages' ELSE '' END AS raw_endpoint,
  CASE k % 3 WHEN 0 THEN '/v1/chat x/completions' WHEN 1 THEN '/v1/messages' ELSE '' END AS endpoint,
  CASE i % 5 WHEN 0 THEN 'team · account-' || (u % 20) || '@example.com' WHEN 1 THEN 'unknown' ELSE '' END AS raw_source,
  'sk-client-' || u || '-key' AS api_key, 'account-' || (u % 20) || '@example.com' AS auth_id, (u % 20)::VARCHAR AS auth_index,
  CASE WHEN u % 2 = 0 THEN 'oauth' ELSE 'apikey' END AS auth_type, k % 2 = 0 AS generate, event_type = 'error' AS failed,
  CASE WHEN event_type = 'error' THEN 429 ELSE 0 END AS status_code, CASE WHEN event_type = 'error' THEN 'rate limited' ELSE '' END AS failure,
  50 + (i * 37) % 5000 AS latency_ms, CASE WHEN k % 4 = 0 THEN 0 ELSE 10 + (i * 13) % 900 END AS ttft_ms,
  10 + i % 1000 + 10 * k AS input_tokens, 5 + i % 300 + k AS output_tokens, CASE WHEN k % 2 = 0 THEN (i % 300) // 4 ELSE 0 END AS reasoning_tokens,
  CASE WHEN k % 3 = 0 THEN (i % 1000) // 2 ELSE 0 END AS cached_tokens, CASE WHEN k % 6 = 0 THEN (i % 1000) // 2 ELSE 0 END AS raw_cache_read,
  CASE WHEN k % 5 = 0 THEN k ELSE 0 END AS cache_creation_tokens, CASE WHEN i % 7 = 0 THEN 0 ELSE 15 + i % 1000 + 10 * k + i % 300 + k END AS raw_total FROM u0)"""
EVENTS = (
    RAW
    + f""",
e1 AS (SELECT *, CASE WHEN id % 5 = 0 OR auth_type = 'oauth' THEN auth_id ELSE auth_index END AS cred FROM u),
e2 AS (SELECT *, {mask("cred")} AS m1 FROM e1),
e AS (SELECT id, timestamp_ms, provider, '' AS executor_type, model, '' AS alias, endpoint, 'key-' || left({hmac("encode(api_key)")}, 8) AS api_key_mask, {hmac("encode(api_key)")} AS api_key_hash,
  '' AS auth_id, '' AS auth_index, '' AS auth_type, {hmac(joined("provider", "auth_id", "auth_index", "auth_type"))} AS upstream_key,
  provider || ' / ' || {mask("m1")} AS upstream_label, provider || ' / ' || {mask("m1")} AS source, '' AS reasoning_effort, '' AS service_tier, generate, latency_ms, ttft_ms, failed, status_code, failure,
  input_tokens, output_tokens, reasoning_tokens, cached_tokens, CASE WHEN raw_cache_read = 0 THEN cached_tokens ELSE raw_cache_read END AS cache_read_tokens, cache_creation_tokens,
  CASE WHEN raw_total = 0 THEN input_tokens + output_tokens ELSE raw_total END AS total_tokens FROM e2)"""
)
_KEYS = "minute, provider, model, source, api_key_hash, upstream_key"
ROLLUPS = (
    EVENTS
    + f""",
r AS (SELECT timestamp_ms // 60000 AS minute, provider, model, source, api_key_hash, upstream_key, max(api_key_mask) AS api_key_mask, max(upstream_label) AS upstream_label,
  count(*)::BIGINT AS requests, count(*) FILTER (NOT failed)::BIGINT AS successes, count(*) FILTER (failed)::BIGINT AS failures, {sums(TOKENS)},
  sum(latency_ms)::BIGINT AS latency_sum_ms, sum(ttft_ms)::BIGINT AS ttft_sum_ms, count(*) FILTER (ttft_ms > 0)::BIGINT AS ttft_count FROM e GROUP BY {_KEYS.replace("minute", "timestamp_ms // 60000")}),
p AS (SELECT * FROM (VALUES {", ".join(str((p[0], *p[1:6])) for p in PRICES)}) t(model, {", ".join(RATES)}))"""
)


def query(select: str, *ctes: str, base: str = ROLLUPS) -> str:
    return f"WITH {','.join([base.lstrip(), *ctes])}\n{select}"


def within(rng: TimeRange) -> str:
    return f"minute BETWEEN {rng.minutes[0]} AND {rng.minutes[1]}"


def bucketed(rng: TimeRange, name: str = "b") -> str:
    n = rng.interval
    return f"{name} AS (SELECT (minute // {n}) * {n} AS bucket, model, {sums(MEASURES)} FROM r WHERE {within(rng)} GROUP BY ALL)"


def priced(source: str, name: str = "c") -> str:
    """`source` with rates, cost_usd and standard_cost_usd."""
    pick = ", ".join(f"CASE WHEN p1.model IS NOT NULL THEN p1.{r} WHEN p2.model IS NOT NULL THEN p2.{r} WHEN p3.model IS NOT NULL THEN p3.{r} ELSE 0.0 END AS {r}" for r in RATES)
    match = "CASE WHEN p1.model IS NOT NULL THEN 'exact' WHEN p2.model IS NOT NULL THEN 'suffix' WHEN p3.model IS NOT NULL THEN 'wildcard' ELSE 'none' END AS price_match"
    cost = lambda read: (
        "(greatest(input_tokens - cache_read_tokens - cache_creation_tokens, 0) * input_per_million + greatest(output_tokens - reasoning_tokens, 0) * output_per_million"
        f" + cache_read_tokens * {read} + cache_creation_tokens * (CASE WHEN cache_write_per_million = 0 THEN input_per_million ELSE cache_write_per_million END)"
        " + reasoning_tokens * (CASE WHEN reasoning_per_million = 0 THEN output_per_million ELSE reasoning_per_million END)) / 1000000.0"
    )
    double = ", ".join(f"{r}::DOUBLE AS {r}" for r in RATES)
    return (
        f"{name}0 AS (SELECT s.*, {match}, {pick} FROM {source} s LEFT JOIN p p1 ON s.model = p1.model LEFT JOIN p p2 ON s.model LIKE '%/%' AND regexp_extract(s.model, '[^/]*$') = p2.model LEFT JOIN p p3 ON p3.model = '*'),"
        f"{name}1 AS (SELECT * EXCLUDE ({', '.join(RATES)}), {double} FROM {name}0),"
        f"{name} AS (SELECT *, {cost('cache_read_per_million')} AS cost_usd, {cost('input_per_million')} AS standard_cost_usd FROM {name}1)"
    )


def kpi(rng: TimeRange) -> str:
    length = f"{(rng.to_ms - rng.from_ms) / 60000}::DOUBLE"
    if rng.label == "all":
        length = f"coalesce((max(bucket) - min(bucket) + {rng.interval})::DOUBLE, {length})"
    totals = f"t AS (SELECT {sums(MEASURES, True)}, coalesce(sum(cost_usd), 0.0) AS cost, coalesce(sum(standard_cost_usd), 0.0) AS standard, {length} AS length FROM c)"
    days, minutes = "greatest(length / 1440, 1.0)", "greatest(length, 1.0)"
    return query(
        f"""SELECT '{rng.label}' AS range_label, requests, successes, failures, total_tokens, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens AS cache_write_tokens, reasoning_tokens,
  round(cost, 9) AS cost_usd, round(standard, 9) AS standard_cost_usd, round({ratio("successes", "requests")}, 6) AS success_rate, round({ratio("latency_sum_ms", "requests")}, 6) AS avg_latency_ms,
  round({ratio("ttft_sum_ms", "ttft_count")}, 6) AS avg_ttft_ms, round({ratio("cache_read_tokens", "input_tokens")}, 6) AS cache_rate, round(requests / {days}, 6) AS avg_requests_daily,
  round(total_tokens / {days}, 6) AS avg_tokens_daily, round(cost / {days}, 9) AS avg_cost_daily, round(requests / {minutes}, 6) AS rpm, round(total_tokens / {minutes}, 6) AS tpm FROM t""",
        bucketed(rng), priced("b"), totals,
    )


def trend_ctes(rng: TimeRange) -> tuple[str, ...]:
    return (
        bucketed(rng), priced("b"),
        f"""t AS (SELECT bucket * 60000 AS timestamp_ms, sum(requests)::BIGINT AS requests, sum(total_tokens)::BIGINT AS tokens, sum(input_tokens)::BIGINT AS input, sum(output_tokens)::BIGINT AS output, sum(cache_read_tokens)::BIGINT AS cache_read,
  sum(cache_creation_tokens)::BIGINT AS cache_write, sum(reasoning_tokens)::BIGINT AS reasoning, round(sum(cost_usd), 9) AS cost_usd, round(sum(standard_cost_usd), 9) AS standard_cost_usd,
  round({ratio("sum(cache_read_tokens)", "sum(input_tokens)")}, 6) AS hit_rate FROM c GROUP BY bucket)""",
    )


def dense_ctes(rng: TimeRange) -> tuple[str, ...]:
    step = rng.interval
    first, last = (m // step * step * 60000 for m in rng.minutes)
    if last - first > 600 * 60000 or rng.label == "all":
        bounds = "SELECT min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM t"
    else:
        bounds = f"SELECT {first} AS lo, {last} AS hi FROM t HAVING count(*) > 0"
    counts = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("requests", "tokens", "input", "output", "cache_read", "cache_write", "reasoning"))
    rest = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("cost_usd", "standard_cost_usd", "hit_rate"))
    return (*trend_ctes(rng), f"g AS (SELECT unnest(range(lo, hi + 1, {step * 60000})) AS timestamp_ms FROM ({bounds}) WHERE lo IS NOT NULL)", f"d AS (SELECT timestamp_ms, {counts}, {rest} FROM g LEFT JOIN t USING (timestamp_ms))")


def health_ctes() -> tuple[str, ...]:
    rng = health_range(NOW_MS)
    first, last = (m // 15 * 15 * 60000 for m in rng.minutes)
    return (
        f"h0 AS (SELECT (minute // 15) * 15 * 60000 AS timestamp_ms, sum(requests)::BIGINT AS requests, sum(failures)::BIGINT AS failures FROM r WHERE {within(rng)} GROUP BY 1)",
        f"""h AS (SELECT g.timestamp_ms, coalesce(requests, 0)::BIGINT AS requests, coalesce(failures, 0)::BIGINT AS failures, round({ratio("coalesce(requests, 0) - coalesce(failures, 0)", "coalesce(requests, 0)")}, 6) AS success_rate,
  ((g.timestamp_ms - {rng.from_ms}) // 900000) // 96 AS day_index, ((g.timestamp_ms - {rng.from_ms}) // 900000) % 96 AS slot_index, strftime(make_timestamp((g.timestamp_ms + 28800000) * 1000), '%Y-%m-%d') AS day
  FROM (SELECT unnest(range({first}, {last} + 1, 900000)) AS timestamp_ms) g LEFT JOIN h0 USING (timestamp_ms))""",
    )


_LABEL = {"model": "model", "provider": "provider", "api_key_hash": "api_key_mask", "source": "source", "upstream_key": "upstream_label"}
_SHOWN = ", ".join(("requests", "successes", "failures", *TOKENS))


def dimension_ctes(rng: TimeRange, key: str, name: str, where: str = "true") -> tuple[str, ...]:
    """`name`: the presented statistics of a dimension; `name`_l: its level one."""
    by = "key, provider" if key == "source" else "key"
    first = "" if key == "source" else "first(provider ORDER BY provider, model) AS provider, "
    return (
        f"{name}_l AS (SELECT {key} AS key, provider, model, max({_LABEL[key]}) AS label, {sums()} FROM r WHERE {within(rng)} AND {where} GROUP BY {key}, provider, model)",
        priced(f"{name}_l", f"{name}_c"),
        f"{name}_2 AS (SELECT {by}, {first}first(label ORDER BY provider, model) AS name, {sums()}, sum(cost_usd) AS cost, count(DISTINCT model)::BIGINT AS models FROM {name}_c GROUP BY {by})",
        presented(f"{name}_2", name),
    )


def presented(source: str, name: str) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY requests DESC, name, key, provider)::INTEGER AS rank_no, key, name, provider, {_SHOWN}, round(cost, 9) AS cost_usd,
  round({ratio("successes", "requests")}, 6) AS success_rate, round({ratio("latency_sum_ms", "requests")}, 6) AS avg_latency_ms, models FROM {source})"""


def public(prefix: str, blob: str) -> str:
    return f"'{prefix}-' || left({hmac(blob, PUBLIC_SALT)}, 8)"


def merged_ctes(rng: TimeRange) -> tuple[str, ...]:
    # stored labels are masked already, so the displayed name is the label
    return (
        f"m_l AS (SELECT source AS key, provider, model, {sums()} FROM r WHERE {within(rng)} GROUP BY source, provider, model)",
        priced("m_l", "m_c"),
        f"m_2 AS (SELECT provider, key AS name, {public('source', joined('provider', 'key'))} AS key, {sums()}, sum(cost_usd) AS cost, count(DISTINCT model)::BIGINT AS models FROM m_c GROUP BY provider, m_c.key)",
        presented("m_2", "sources"),
    )


def analysis_ctes(rng: TimeRange) -> tuple[str, ...]:
    keyed = f"* REPLACE ({public('key', 'encode(key)')} AS key, {public('key', 'encode(key)')} AS name)"
    return (
        *dimension_ctes(rng, "model", "dm"), *dimension_ctes(rng, "provider", "dp"), *dimension_ctes(rng, "api_key_hash", "dk"), *merged_ctes(rng),
        f"a AS (SELECT 'models' AS distribution, * FROM dm UNION ALL BY NAME SELECT 'providers' AS distribution, * FROM dp UNION ALL BY NAME SELECT 'api_keys' AS distribution, {keyed} FROM dk UNION ALL BY NAME SELECT 'sources' AS distribution, * FROM sources)",
    )


def interface_ctes(rng: TimeRange) -> tuple[str, ...]:
    keyed = f"* REPLACE ({public('key', 'encode(key)')} AS key, {public('key', 'encode(key)')} AS name)"
    return (*dimension_ctes(rng, "api_key_hash", "dk"), *dimension_ctes(rng, "upstream_key", "du"), f"f AS (SELECT 'api_keys' AS kind, {keyed} FROM dk UNION ALL BY NAME SELECT 'upstreams' AS kind, * FROM du)")


REDACTED = f"* REPLACE ({public('key', 'encode(api_key_hash)')} AS api_key_mask, '' AS api_key_hash, '' AS upstream_key)"
EXPORTED = f"""strftime(make_timestamp(timestamp_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time, provider, model, endpoint, {public("key", "encode(api_key_hash)")} AS api_key, upstream_label AS upstream, source,
  CASE WHEN failed THEN 'failure' ELSE 'success' END AS status, status_code, latency_ms, ttft_ms, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens AS cache_write_tokens, reasoning_tokens, total_tokens, failure"""
UPSTREAM = hmac(joined("'prov-1'", "'account-5@example.com'", "'5'", "'apikey'"))


def event_range(rng: TimeRange) -> str:
    low = f"timestamp_ms >= {rng.from_ms} AND " if rng.from_ms > 0 else ""
    return f"{low}timestamp_ms <= {rng.to_ms}"


def oracle_sql() -> dict[str, str]:
    r30, r24, rall, r7 = (time_range(NOW_MS, x) for x in ("30d", "24h", "all", "7d"))
    custom = time_range(NOW_MS, "custom", *CUSTOM)
    on_events = lambda s, *c: query(s, *c, base=EVENTS)
    on_raw = lambda s, *c: query(s, *c, base=RAW)
    c_value = "CASE c_custkey % 6 WHEN 0 THEN c_name || '.json' WHEN 1 THEN left(c_name, (c_custkey % 9)::INTEGER) WHEN 2 THEN '  ' || c_name || '.yaml.json ' WHEN 3 THEN c_name || '@x.example' WHEN 4 THEN '' ELSE c_custkey::VARCHAR END"
    cleaned = "trim(regexp_replace(regexp_replace(regexp_replace(trim(v), '\\.json$', ''), '\\.yaml$', ''), '\\.yml$', ''))"
    dirty = lambda n: f"CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || chr(10) WHEN 1 THEN repeat(c_name || chr(9), {n}) WHEN 2 THEN ' ' || chr(9) ELSE c_name || chr(127) || c_mktsegment END"
    ws = "regexp_replace(v, '^[\\x09-\\x0D ]+|[\\x09-\\x0D ]+$', '', 'g')"
    page = "ORDER BY timestamp_ms DESC, id DESC LIMIT 25 OFFSET 50"
    out = {
        "decode_usage": on_raw(
            "SELECT id, provider, model, raw_endpoint AS endpoint, raw_source AS source, api_key, auth_id, auth_index, auth_type, generate AS streamed, failed, timestamp_ms AS requested_at_ms, latency_ms * 1000000 AS latency_ns, ttft_ms * 1000000 AS ttft_ns FROM u"
        ),
        "decode_failure": on_raw("SELECT id, status_code, failure FROM u"),
        "decode_token_detail": on_raw(
            "SELECT id, input_tokens, output_tokens, reasoning_tokens, cached_tokens, CASE WHEN id % 4 = 2 THEN cached_tokens ELSE raw_cache_read END AS cache_read_tokens, cache_creation_tokens, raw_total AS total_tokens FROM u"
        ),
        "parse_event_time": on_raw("SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 = 1 THEN timestamp_ms // 1000 * 1000 ELSE timestamp_ms END AS time_ms FROM u"),
        "parse_duration": on_raw(
            "SELECT id, CASE id % 6 WHEN 0 THEN latency_ms * 1000000 WHEN 1 THEN latency_ms * 1000000 WHEN 2 THEN 3723500000000 + latency_ms * 1000 WHEN 3 THEN -latency_ms * 1000000000 WHEN 4 THEN latency_ms * 1000000 + 500000 ELSE 0 END AS duration_ns FROM u"
        ),
        "malformed_records": on_raw("SELECT id FROM u WHERE id % 11 < 3"),
        "compact_events": on_events("SELECT * REPLACE (provider || ' / ' || m1 AS source, provider || ' / ' || m1 AS upstream_label) FROM (SELECT e.*, e2.m1 FROM e JOIN e2 USING (id)) x").replace(
            "SELECT * REPLACE", "SELECT * EXCLUDE (m1) REPLACE"
        ),
        "normalize_events": on_events("SELECT * FROM e"),
        "redacted_events": on_events(f"SELECT {REDACTED} FROM e"),
        "uncached_input": on_events("SELECT id, greatest(input_tokens - (CASE WHEN cache_read_tokens = 0 THEN cached_tokens ELSE cache_read_tokens END) - cache_creation_tokens, 0) AS uncached_input_tokens FROM e"),
        "minute_rollup": query("SELECT * FROM r"),
        "merge_rollups": query("SELECT * FROM r"),
        "bucket_model_aggregate": query("SELECT * FROM b", bucketed(r30)),
        "price_list": "SELECT p_brand || '/' || p_type AS model, min(p_retailprice) / 100 AS input_per_million, max(p_retailprice) / 100 AS output_per_million FROM part GROUP BY 1",
        "validate_prices": """WITH v AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 90 = 7 THEN '  ' ELSE ' ' || p_name || '-' || (p_partkey % 1500) || ' ' END) AS model, CASE WHEN p_partkey % 50 = 0 THEN -1.0 ELSE p_retailprice / 100 END AS i, CASE WHEN p_partkey % 77 = 0 THEN 2e6 ELSE 0.5 END AS o FROM part),
w AS (SELECT *, count(*) OVER (PARTITION BY model) AS n FROM v)
SELECT p_partkey, model, CASE WHEN model = '' THEN 'name' WHEN n > 1 THEN 'duplicate' WHEN i < 0 OR o > 1e6 THEN 'rate' END AS reason FROM w""",
        "price_resolution": query(f"SELECT model, price_match, {', '.join(RATES)} FROM c", "b AS (SELECT model, " + sums() + " FROM r GROUP BY model)", priced("b")),
        "cost_by_model": query("SELECT model, round(cost_usd, 9) AS cost_usd FROM c", "b AS (SELECT model, " + sums() + " FROM r GROUP BY model)", priced("b")),
        "standard_cost": query("SELECT model, round(standard_cost_usd, 9) AS standard_cost_usd FROM c", "b AS (SELECT model, " + sums() + " FROM r GROUP BY model)", priced("b")),
        "export_events": on_events(f"SELECT {EXPORTED} FROM (SELECT * FROM e WHERE failed ORDER BY timestamp_ms DESC, id DESC LIMIT 50000)"),
        "backup_events": on_events("SELECT *, (SELECT count(*) > 50000 FROM e) AS truncated FROM e ORDER BY timestamp_ms, id LIMIT 50000"),
        "validate_backup": on_events(
            "SELECT min(n) AS bad_ordinal, arg_min(reason, n) AS reason, count(*) AS bad_events FROM (SELECT id + 1 AS n, CASE WHEN id % 1009 = 7 THEN 'invalid' WHEN id % 97 = 5 THEN 'a measure is negative' END AS reason FROM e) WHERE reason IS NOT NULL"
        ),
        "retention_events": on_events(f"SELECT id FROM e WHERE timestamp_ms >= {NOW_MS - 10 * 86400000}"),
        "retention_rollups": query(f"SELECT minute, sum(requests)::BIGINT AS requests FROM r WHERE minute >= {(NOW_MS - 10 * 86400000) // 60000} GROUP BY minute"),
        "table_status": query("SELECT (SELECT count(*) FROM e) AS events, (SELECT max(timestamp_ms) FROM e) AS last_event_ms, (SELECT count(*) FROM r) AS rollups"),
        "hmac_pseudonym": f"SELECT c_custkey, {hmac('encode(c_name)')} AS pseudonym FROM customer",
        "public_identifier": f"SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'key-unknown' ELSE {public('key', 'encode(s_name)')} END AS public_id FROM supplier",
        "mask_credential": f"SELECT c_custkey, {mask('w')} AS masked FROM (SELECT c_custkey, {cleaned} AS w FROM (SELECT c_custkey, {c_value} AS v FROM customer))",
        "clean_dimension": f"SELECT c_custkey, CASE WHEN w = '' THEN 'none' ELSE regexp_replace(left(w, 160), '[\\x00-\\x1F\\x7F]', '', 'g') END AS cleaned FROM (SELECT c_custkey, {ws} AS w FROM (SELECT c_custkey, {dirty(12)} AS v FROM customer))",
        "sanitize_failure": f"SELECT c_custkey, regexp_replace(left(w, 512), '[\\x00-\\x1F\\x7F]', '', 'g') AS cleaned FROM (SELECT c_custkey, {ws} AS w FROM (SELECT c_custkey, {dirty(40)} AS v FROM customer))",
        "sanitize_endpoint": "SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages",
        "masked_upstream_label": on_raw(f"SELECT id, CASE id % 3 WHEN 0 THEN provider ELSE CASE id % 3 WHEN 1 THEN 'team' ELSE provider END END || ' / ' || CASE id % 3 WHEN 2 THEN 'abc***yz' ELSE {mask('auth_id')} END AS label FROM u"),
        "filter_events": on_events(f"SELECT * FROM e WHERE {event_range(r30)} AND model = 'tarn' AND provider = 'prov-1' AND failed AND upstream_key = {UPSTREAM}"),
        "search_events": on_events(
            "SELECT id FROM e WHERE lower(model) LIKE '%orion_4%' OR lower(provider) LIKE '%orion_4%' OR lower(endpoint) LIKE '%orion_4%' OR lower(upstream_label) LIKE '%orion_4%' OR lower(source) LIKE '%orion_4%' OR lower(failure) LIKE '%orion_4%'"
        ),
        "events_page": on_events(f"SELECT {REDACTED} FROM (SELECT * FROM e WHERE {event_range(r7)} AND provider = 'prov-1' {page})"),
        "events_page_newest": on_events(f"SELECT {REDACTED} FROM (SELECT * FROM e ORDER BY timestamp_ms DESC, id DESC LIMIT 25)"),
        "events_page_deep": on_events(f"SELECT {REDACTED} FROM (SELECT * FROM e WHERE failed ORDER BY timestamp_ms DESC, id DESC LIMIT 25 OFFSET 725)"),
        "events_page_meta": on_events(f"SELECT count(*) AS total, (count(*) + 24) // 25 AS pages, 3::BIGINT AS page, 25::BIGINT AS page_size FROM e WHERE {event_range(r7)} AND provider = 'prov-1'"),
        "upstream_recent_events": on_events(f"SELECT {REDACTED} FROM (SELECT * FROM e WHERE {event_range(r30)} AND upstream_key = {UPSTREAM} ORDER BY timestamp_ms DESC, id DESC LIMIT 20)"),
        "summary_kpi": kpi(r30),
        **{f"range_{x.label}": kpi(x) for x in (r24, r7, time_range(RANGE_30D_NOW, "30d"), rall, custom)},
        "trend": query("SELECT * FROM t", *trend_ctes(r30)),
        "trend_dense": query("SELECT '24h' AS range_label, * FROM d", *dense_ctes(r24)),
        "trend_dense_custom": query("SELECT * FROM d", *dense_ctes(custom)),
        "trend_nonempty": query("SELECT * FROM d WHERE requests > 0 OR tokens > 0 OR input > 0 OR output > 0 OR cache_read > 0 OR reasoning > 0 OR cost_usd > 0", *dense_ctes(custom)),
        "sparkline": query(
            "SELECT i AS index, x.value FROM (SELECT unnest(range(0, (SELECT least(count(*), 14) FROM d))) AS i) JOIN (SELECT row_number() OVER (ORDER BY timestamp_ms) - 1 AS n, count(*) OVER () AS c, requests::DOUBLE AS value FROM d) x"
            " ON x.n = (2 * i * (c - 1) + (least(c, 14) - 1)) // (2 * (least(c, 14) - 1))",
            *dense_ctes(r24),
        ),
        "health_grid": query("SELECT * FROM h", *health_ctes()),
        "health_levels": query(
            f"SELECT timestamp_ms, requests, failures, CASE WHEN requests = 0 THEN 0 WHEN rate < 0.5 THEN 1 WHEN rate < 0.65 THEN 2 WHEN rate < 0.8 THEN 3 WHEN rate < least(0.99, 0.9 + 0.045 * greatest(0.0, log10(greatest(requests, 1) / 10.0))) THEN 4 ELSE 5 END AS level FROM (SELECT *, {ratio('requests - failures', 'requests')} AS rate FROM h)",
            *health_ctes(),
        ),
        "health_totals": query(f"SELECT *, round({ratio('successes', 'requests')}, 6) AS success_rate FROM (SELECT sum(requests)::BIGINT AS requests, (sum(requests) - sum(failures))::BIGINT AS successes, sum(failures)::BIGINT AS failures FROM h)", *health_ctes()),
        "dimension_level1": query("SELECT * FROM x_l", *dimension_ctes(r30, "upstream_key", "x")),
        **{f"dim_{n}": query("SELECT * FROM x", *dimension_ctes(r30, k, "x")) for n, k in (("model", "model"), ("provider", "provider"), ("api_key", "api_key_hash"), ("source", "source"), ("upstream", "upstream_key"))},
        "dim_source_merged": query("SELECT * FROM sources", *merged_ctes(r30)),
        "analysis_distributions": query("SELECT * FROM a", *analysis_ctes(r30)),
        "analysis_tokens": query(f"SELECT {sums(TOKENS, True)} FROM dm", *dimension_ctes(r30, "model", "dm")),
        "token_composition": query(
            f"SELECT part, tokens, round({ratio('tokens * 100', 'sum(tokens) OVER ()')}, 6) AS percent FROM (SELECT unnest(['input', 'output', 'cache_read', 'cache_write', 'reasoning']) AS part, unnest([greatest(i - c - w, 0), greatest(o - g, 0), c, w, g])::BIGINT AS tokens FROM (SELECT sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS c, sum(cache_creation_tokens) AS w, sum(reasoning_tokens) AS g FROM dm))",
            *dimension_ctes(r30, "model", "dm"),
        ),
        "distribution_top5": query(f"SELECT distribution, rank_no, name, requests, round({ratio('requests * 100', 'sum(requests) OVER (PARTITION BY distribution)')}, 1) AS percent FROM a WHERE rank_no <= 5 AND requests > 0", *analysis_ctes(r30)),
        "filter_options": query("SELECT DISTINCT distribution, key, name FROM a WHERE distribution IN ('models', 'providers')", *analysis_ctes(r30)),
        "interfaces": query("SELECT * FROM f", *interface_ctes(r30)),
        "interface_summary": query(
            f"SELECT active_keys, upstreams, requests, round({ratio('w', 'requests')}, 3) AS avg_latency_ms, healthy FROM (SELECT count(*) FILTER (kind = 'api_keys') AS active_keys, count(*) FILTER (kind = 'upstreams') AS upstreams, coalesce(sum(requests) FILTER (kind = 'upstreams'), 0)::BIGINT AS requests, coalesce(sum(avg_latency_ms * requests) FILTER (kind = 'upstreams'), 0.0) AS w, count(*) FILTER (kind = 'upstreams' AND success_rate >= 0.9) AS healthy FROM f)",
            *interface_ctes(r30),
        ),
        "api_key_share": query(f"SELECT key, requests, round(least(100.0, {ratio('requests * 100', 'sum(requests) OVER ()')}), 6) AS percent FROM f WHERE kind = 'api_keys'", *interface_ctes(r30)),
        "upstream_share": query(f"SELECT key, requests, round(least(100.0, {ratio('requests * 100', 'sum(requests) OVER ()')}), 6) AS percent FROM f WHERE kind = 'upstreams'", *interface_ctes(r30)),
        "upstream_status": query("SELECT key, name, success_rate, CASE WHEN success_rate >= 0.98 THEN 'online' WHEN success_rate >= 0.9 THEN 'unsteady' ELSE 'attention' END AS status FROM f WHERE kind = 'upstreams'", *interface_ctes(r30)),
        "upstream_detail_models": query("SELECT * FROM x", *dimension_ctes(r30, "model", "x", f"upstream_key = {UPSTREAM}")),
        "upstream_summary": query(
            f"SELECT {UPSTREAM} AS key, (SELECT max(source) FROM r WHERE {within(r30)} AND upstream_key = {UPSTREAM}) AS name, {_SHOWN}, round(cost, 9) AS cost_usd, round({ratio('successes', 'requests')}, 6) AS success_rate, round({ratio('latency_sum_ms', 'requests')}, 6) AS avg_latency_ms FROM (SELECT {sums(SUMS, True)}, coalesce(sum(cost), 0.0) AS cost FROM x_2)",
            *dimension_ctes(r30, "model", "x", f"upstream_key = {UPSTREAM}"),
        ),
    }
    return out
