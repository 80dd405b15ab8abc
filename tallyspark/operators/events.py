"""Events: compaction, normalisation, redaction, filters, pages, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.decode import decode_records
from ..functions.text import clean_dimension, like_ascii, sanitize_endpoint, sanitize_failure, text, trim
from ..sources.schema import EVENT, EVENT_COLUMNS, TOKENS
from .identities import by_distinct
from .ranges import DAY

MS_NS = 1_000_000


def decode_usage(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Decodes JSON usage records (malformed ones have a true `malformed` column), keeping the other columns."""
    return decode_records(raw, column)


def malformed_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The malformed ones of JSON usage records, with the other columns.

    They are counted as they pass (metrics `records` and `malformed`). A condition stays above what is observed,
    so a record is made and parsed once, in the tasks it was dealt to; below, each of its uses would parse it again.
    """
    told = decode_usage(raw, column).select("malformed", *[c for c in raw.columns if c != column])
    counted = told.observe("malformed_records", F.count(F.lit(1)).alias("records"), F.count_if("malformed").alias("malformed"))
    return counted.where("malformed").drop("malformed")


def _material(provider: Column, auth_id: Column, auth_index: Column, auth_type: Column) -> Column:
    return F.concat_ws("\0", provider, text(auth_id), text(auth_index), text(auth_type))


#: What a record's identity columns hang on, and its other texts but the failure.
RECORD_IDENTITY = ("provider", "auth_id", "auth_index", "auth_type", "source", "api_key")
RECORD_TEXTS = ("executor_type", "model", "alias", "endpoint", "reasoning_effort", "service_tier")


#: What the identity of a record's upstream hangs on.
RECORD_UPSTREAM = RECORD_IDENTITY[:-1]


def _key_hash(salt: str) -> Column:
    return F.when(text(F.col("api_key")) == "", "").otherwise(ids.short_hmac(F.col("api_key"), salt))


def record_identities(rows: DataFrame, salt: str) -> DataFrame:
    """Columns _provider, _hash, _upstream, _label and _mask of records."""
    c = F.col
    provider = clean_dimension(c("provider"), "unknown")
    upstream = ids.short_hmac(_material(c("_provider"), c("auth_id"), c("auth_index"), c("auth_type")), salt)
    first = rows.withColumn("_provider", provider).withColumns({"_upstream": upstream, "_hash": _key_hash(salt), "_named": ids.credential_from_source(c("_provider"), c("source"))})
    credential = F.when(c("_named") == "", ids.preferred_credential(c("auth_type"), c("auth_id"), c("auth_index"))).otherwise(c("_named"))
    return first.withColumns({"_label": ids.credential_label(c("_provider"), credential, c("_upstream")), "_mask": ids.anonymous_label("key", c("_hash"))}).drop("_named")


def event_identities(rows: DataFrame, salt: str) -> DataFrame:
    """The same of events: hashes what isn't hashed and recomputes labels."""
    c = F.col
    key, upstream_key = text(c("api_key_hash")), text(c("upstream_key"))
    hashed = F.when((key == "") | ids.is_hex_digest(key), key).otherwise(ids.short_hmac(key, salt))
    made = ids.short_hmac(_material(c("_provider"), c("auth_id"), c("auth_index"), c("auth_type")), salt)
    upstream = F.when(upstream_key == "", made).when(ids.is_hex_digest(upstream_key), upstream_key).otherwise(ids.short_hmac(upstream_key, salt))
    first = rows.withColumn("_provider", clean_dimension(c("provider"), "unknown")).withColumns({"_hash": hashed, "_upstream": upstream, "_named": ids.credential_from_source(c("_provider"), c("source"))})
    credential = F.when(c("_named") == "", ids.preferred_credential(c("auth_type"), c("auth_id"), c("auth_index"))).otherwise(c("_named"))
    first = first.withColumn("_credential", credential)
    return first.withColumns({"_label": ids.stored_label(c("_provider"), c("_credential"), c("upstream_label"), c("_upstream")), "_mask": ids.anonymous_label("key", c("_hash"))}).drop("_named", "_credential")


def compact_events(decoded: DataFrame, salt: str = ids.SALT, ingest_ms: Column | None = None) -> DataFrame:
    """Decoded records as events: cleaned, defaulted, clamped, without raw identities.

    decoded: the columns of decode_records and `id`. A missing time becomes `ingest_ms`.
    """
    first = record_identities(decoded, salt).withColumns(record_texts())
    return _compacted(first, ingest_ms)


def record_texts() -> dict[str, Column]:
    """Columns _model and so on of records: what the other texts but the failure become."""
    cleaned = {f"_{n}": clean_dimension(F.col(n)) for n in ("executor_type", "alias", "reasoning_effort", "service_tier")}
    return {**cleaned, "_model": clean_dimension(F.col("model"), "unknown"), "_endpoint": sanitize_endpoint(F.col("endpoint"))}


def _compacted(first: DataFrame, ingest_ms: Column | None) -> DataFrame:
    c = F.col
    now = F.unix_millis(F.current_timestamp()) if ingest_ms is None else ingest_ms
    zero = F.lit(0).cast("long")
    clamp = lambda x: F.greatest(F.coalesce(x, zero), zero)
    cache_read = F.when(c("cache_read_tokens") == 0, c("cached_tokens")).otherwise(c("cache_read_tokens"))
    total = F.when(c("total_tokens") == 0, c("input_tokens") + c("output_tokens")).otherwise(c("total_tokens"))
    values = {
        "id": c("id"), "timestamp_ms": F.coalesce(c("requested_at_ms"), now), "provider": c("_provider"), "executor_type": c("_executor_type"), "model": c("_model"),
        "alias": c("_alias"), "endpoint": c("_endpoint"), "api_key_mask": c("_mask"), "api_key_hash": c("_hash"),
        "auth_id": F.lit(""), "auth_index": F.lit(""), "auth_type": F.lit(""), "upstream_key": c("_upstream"), "upstream_label": c("_label"), "source": c("_label"),
        "reasoning_effort": c("_reasoning_effort"), "service_tier": c("_service_tier"), "generate": c("generate") | c("stream"),
        "latency_ms": clamp(F.expr(f"latency_ns div {MS_NS}")), "ttft_ms": clamp(F.expr(f"ttft_ns div {MS_NS}")), "failed": c("failed"), "status_code": c("status_code"), "failure": sanitize_failure(c("failure")),
        **{t: clamp(c(t)) for t in TOKENS}, "cache_read_tokens": clamp(cache_read), "total_tokens": clamp(total),
    }
    return first.select(*[values[n].cast(kind).alias(n) for n, kind in EVENT.items()])


def normalize_events(events: DataFrame, salt: str = ids.SALT) -> DataFrame:
    """The second pass, on storage, backup and restore: hashes what isn't hashed, recomputes labels, drops raw identities."""
    c = F.col
    first = event_identities(events, salt)
    values = {
        "provider": c("_provider"), "model": clean_dimension(c("model"), "unknown"), "endpoint": sanitize_endpoint(c("endpoint")), "api_key_hash": c("_hash"), "api_key_mask": c("_mask"),
        "upstream_key": c("_upstream"), "upstream_label": c("_label"), "source": c("_label"), "auth_id": F.lit(""), "auth_index": F.lit(""), "auth_type": F.lit(""), "failure": sanitize_failure(c("failure")),
    }
    return first.select(*[values.get(n, c(n)).cast(kind).alias(n) for n, kind in EVENT.items()])


def stored_events(decoded: DataFrame, salt: str = ids.SALT, ingest_ms: Column | None = None) -> DataFrame:
    """normalize_events of compact_events, with identities of upstreams and texts worked out once for each distinct one (by_distinct); for tables, not for streams.

    Clients' keys are hashed where they are: there may be as many as fill no broadcast, and a row's one hash, which normalising keeps, is far cheaper than its shuffle.
    """
    c = F.col

    def identities(rows: DataFrame) -> DataFrame:
        own = ("_provider", "_upstream", "_label")
        made = record_identities(rows.withColumn("api_key", F.lit("")), salt)
        as_event = {"provider": c("_provider"), "auth_id": F.lit(""), "auth_index": F.lit(""), "auth_type": F.lit(""), "source": c("_label"), "api_key_hash": F.lit(""), "upstream_key": c("_upstream"), "upstream_label": c("_label")}
        again = event_identities(made.select(*[c(k).alias(f"_raw_{k}") for k in RECORD_UPSTREAM], *[v.alias(k) for k, v in as_event.items()]), salt)
        return again.select(*[c(f"_raw_{k}").alias(k) for k in RECORD_UPSTREAM], *own)

    def texts(rows: DataFrame) -> DataFrame:
        return rows.withColumns(record_texts()).withColumns({"_model": clean_dimension(c("_model"), "unknown"), "_endpoint": sanitize_endpoint(c("_endpoint"))})

    first = by_distinct(decoded, {RECORD_UPSTREAM: identities, RECORD_TEXTS: texts})
    first = first.withColumn("_hash", _key_hash(salt)).withColumn("_mask", ids.anonymous_label("key", c("_hash")))
    return _compacted(first, ingest_ms).withColumn("failure", sanitize_failure(c("failure")))


def redact_events(events: DataFrame) -> DataFrame:
    """Events for display: public key labels, masked upstream labels, no keys of accounts."""
    c = F.col
    label = ids.masked_label(c("provider"), c("source"), c("upstream_key"))
    values = {
        "api_key_mask": ids.public_identifier("key", c("api_key_hash")), "api_key_hash": F.lit(""), "auth_id": F.lit(""), "auth_index": F.lit(""), "auth_type": F.lit(""),
        "upstream_label": label, "upstream_key": F.lit(""), "source": label, "failure": sanitize_failure(c("failure")),
    }
    return events.select(*[values.get(n, c(n)).alias(n) for n in EVENT_COLUMNS])


def uncached_input(events: DataFrame) -> DataFrame:
    """id and the input tokens that no cache served."""
    read = F.coalesce(F.nullif("cache_read_tokens", F.lit(0)), F.col("cached_tokens"))
    part = lambda x: F.greatest(x, F.lit(0))
    return events.select("id", part(part(F.col("input_tokens")) - part(read) - part(F.col("cache_creation_tokens"))).alias("uncached_input_tokens"))


@dataclass(frozen=True)
class EventFilter:
    """Conditions on events; empty ones don't apply. Keys are compared as stored."""

    from_ms: int = 0
    to_ms: int = 0
    model: str = ""
    provider: str = ""
    api_key_hash: str = ""
    upstream_key: str = ""
    status: str = ""
    search: str = ""
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        if self.status not in ("", "success", "failure"):
            raise ValueError("status must be success or failure")
        cut = lambda s, n: s.strip().encode()[:n].decode("utf-8", "ignore")
        for name in ("model", "provider", "api_key_hash", "upstream_key"):
            object.__setattr__(self, name, cut(getattr(self, name), 160))
        object.__setattr__(self, "search", cut(self.search, 120))
        object.__setattr__(self, "page", max(1, self.page))
        object.__setattr__(self, "page_size", 25 if self.page_size < 1 else min(200, self.page_size))


SEARCHED = ("model", "provider", "endpoint", "upstream_label", "source", "failure")


def filter_events(events: DataFrame, f: EventFilter) -> DataFrame:
    """Events that fit; an event_date (the UTC day, by which stored events are cut) is kept and prunes folders."""
    out = events
    if "event_date" in events.columns:
        day = lambda ms: F.date_from_unix_date(F.lit(ms // DAY).cast("int"))
        if f.from_ms > 0:
            out = out.where(F.col("event_date") >= day(f.from_ms))
        if f.to_ms > 0:
            out = out.where(F.col("event_date") <= day(f.to_ms))
    if f.from_ms > 0:
        out = out.where(F.col("timestamp_ms") >= f.from_ms)
    if f.to_ms > 0:
        out = out.where(F.col("timestamp_ms") <= f.to_ms)
    for name in ("model", "provider", "api_key_hash", "upstream_key"):
        if getattr(f, name):
            out = out.where(F.col(name) == getattr(f, name))
    if f.status:
        out = out.where(F.col("failed") == (f.status == "failure"))
    if f.search:
        hit = None
        for name in SEARCHED:
            own = like_ascii(F.col(name), f"%{f.search}%")
            hit = own if hit is None else hit | own
        out = out.where(hit)
    return out


def newest(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("timestamp_ms"), F.desc("id"))


def events_page(events: DataFrame, f: EventFilter) -> DataFrame:
    """One page of redacted events, newest first; redaction is done after the limit."""
    return redact_events(newest(filter_events(events, f)).offset((f.page - 1) * f.page_size).limit(f.page_size))


def events_page_meta(events: DataFrame, f: EventFilter) -> DataFrame:
    """total, pages, page, page_size: one row."""
    total = filter_events(events, f).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.expr(f"(total + {f.page_size} - 1) div {f.page_size}").alias("pages"), F.lit(f.page).cast("long").alias("page"), F.lit(f.page_size).cast("long").alias("page_size"))


def export_events(events: DataFrame, f: EventFilter, most: int = 50_000) -> DataFrame:
    """The newest `most` events that fit, redacted, with the columns of the CSV export."""
    return exported(newest(filter_events(events, f)).limit(most))


def exported(events: DataFrame) -> DataFrame:
    """Events as the CSV export shows them, redacted."""
    c = F.col
    return redact_events(events).select(
        F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), "provider", "model", "endpoint", c("api_key_mask").alias("api_key"), c("upstream_label").alias("upstream"), "source",
        F.when(c("failed"), "failure").otherwise("success").alias("status"), "status_code", "latency_ms", "ttft_ms", "input_tokens", "output_tokens", "cache_read_tokens",
        c("cache_creation_tokens").alias("cache_write_tokens"), "reasoning_tokens", "total_tokens", "failure",
    )


def backup_events(events: DataFrame, most: int = 50_000) -> DataFrame:
    """The oldest `most` events, normalised, with `truncated`: whether there are more."""
    more = events.select("id").limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"))
    rows = normalize_events(events.orderBy("timestamp_ms", "id").limit(most))
    return rows.join(F.broadcast(more))  # one row


def validate_backup(events: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """bad_ordinal and reason of the first invalid event (nulls if all are valid), and how many are invalid."""
    from ..sources.schema import EVENT_MEASURES

    blank = (trim(F.col("model")) == "") | (trim(F.col("provider")) == "") | (F.coalesce(F.col("timestamp_ms"), F.lit(0)) <= 0)
    negative = F.least(*[F.coalesce(F.col(m), F.lit(0)) for m in EVENT_MEASURES]) < 0
    reason = F.when(blank, "invalid").when(negative, "a measure is negative")
    bad = events.select(F.col(ordinal).alias("n"), reason.alias("reason")).where("reason is not null")
    return bad.agg(F.min("n").alias("bad_ordinal"), F.min_by("reason", "n").alias("reason"), F.count(F.lit(1)).alias("bad_events"))
