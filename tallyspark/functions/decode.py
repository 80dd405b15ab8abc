"""Decoding of usage records in their wire dialects.

Records come as JSON text in snake_case (with some camelCase and vendor spellings) or
PascalCase. Each dialect is parsed once with its own declared schema, as names that differ in
case only can't stand in one struct; other spellings are not known. A wrong type in a text
field is read as text; in numbers, flags and objects it makes the record malformed. Times and
durations may be text or numbers; a duration in text has at most MOST_PIECES pieces like 2h, and
one below a nanosecond is 0 and final.

The rules are SQL text, staged in projections: each stage refers to columns of the one before, so
nothing is computed twice, all of it is generated code, and plans are built in a few calls. (Taking
each field from a VARIANT was tried: a hundred path lookups a record took three times as long, and
their code was too large to be compiled.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITE

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
NAMES = ("provider", "executor_type", "model", "alias", "api_key", "auth_id", "auth_index", "auth_type", "endpoint", "source", "reasoning_effort", "service_tier")
PASCAL = {n: {"api_key": "APIKey", "auth_id": "AuthID"}.get(n, n.title().replace("_", "")) for n in NAMES}
UNIT_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
MOST_PIECES = 8


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_SPLIT = _struct(cached_tokens=_L, cache_write_tokens=_L, cache_creation_tokens=_L)
SNAKE_DETAIL = _struct(
    input_tokens=_L, output_tokens=_L, reasoning_tokens=_L, cached_tokens=_L, cache_read_tokens=_L, cache_creation_tokens=_L, total_tokens=_L,
    prompt_tokens=_L, completion_tokens=_L, cache_read_input_tokens=_L, cache_creation_input_tokens=_L,
    prompt_tokens_details=_SPLIT, input_tokens_details=_SPLIT, completion_tokens_details=_struct(reasoning_tokens=_L),
    InputTokens=_L, OutputTokens=_L, ReasoningTokens=_L, CachedTokens=_L, CacheReadTokens=_L, CacheCreationTokens=_L, TotalTokens=_L,
)
FAILURE = _struct(status_code=T.IntegerType(), StatusCode=T.IntegerType(), body=_S)
SNAKE = _struct(
    **{n: _S for n in NAMES}, base_url=_S, baseURL=_S, stream=_B, streaming=_B, generate=_B, failed=_B, failure=FAILURE, detail=SNAKE_DETAIL,
    requested_at=_S, requested_at_ms=_S, RequestedAt=_S, RequestedAtMs=_S,
    latency=_S, latency_ms=_S, LatencyMs=_S, ttft=_S, ttft_ms=_S, TTFTMs=_S, _corrupt_record=_S,
)
LEGACY = _struct(**{PASCAL[n]: _S for n in NAMES}, BaseURL=_S, Stream=_B, Streaming=_B, Generate=_B, Failed=_B, Failure=FAILURE, Detail=SNAKE_DETAIL, Latency=_S, TTFT=_S, _corrupt_record=_S)


_BAD = "_corrupt_record"
_WHITE = "".join(f"\\u{ord(c):04x}" for c in WHITE)
_NUMBER = r"r'\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z'"
_STAMP = r"r'\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z'"
_PIECE = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
_DURATION = rf"r'\A[+-]?({_PIECE}){{1,{MOST_PIECES}}}\z'"


def _trimmed(value: str) -> str:
    return f"btrim(coalesce({value}, ''), '{_WHITE}')"


def _first_filled(*values: str) -> str:
    return f"coalesce({', '.join(f'CASE WHEN {_trimmed(v)} <> {chr(39) * 2} THEN {v} END' for v in values)}, '')"


def _first_nonzero(*values: str) -> str:
    return f"coalesce({', '.join(f'nullif({v}, 0)' for v in values)}, 0)"


def parse_record(raw: Column) -> tuple[Column, Column]:
    """The record by both schemas; fields that are missing are null."""
    return tuple(F.from_json(raw, schema, {"columnNameOfCorruptRecord": _BAD}) for schema in (SNAKE, LEGACY))


def _number(v: str) -> str:
    """A decimal number in trimmed text, else null."""
    return f"CASE WHEN {v} RLIKE {_NUMBER} THEN try_cast({v} AS double) END"


def _time_of_number(x: str) -> str:
    def at(unit: str, to_ns: str) -> str:
        seconds = f"CAST(CASE WHEN {x} < 0 THEN ceil({x} / {unit}) ELSE floor({x} / {unit}) END AS double)"
        return f"CAST({seconds} * 1000 + floor(round(({x} - {seconds} * {unit}) * {to_ns}) / 1e6D) AS bigint)"

    return f"CASE WHEN abs({x}) >= 9e18D THEN NULL WHEN abs({x}) >= 1e17D THEN {at('1e9D', '1D')} WHEN abs({x}) >= 1e12D THEN {at('1e3D', '1e6D')} WHEN abs({x}) > 0 THEN {at('1D', '1e9D')} END"


def _stamp(v: str) -> str:
    return f"CASE WHEN {v} RLIKE {_STAMP} THEN unix_millis(try_cast(replace({v}, ',', '.') AS timestamp)) END"


def _sum_of_pieces(v: str, amounts: str, units: str) -> str:
    sizes = f"map({', '.join(f'{chr(39)}{u}{chr(39)}, {n}L' for u, n in UNIT_NS.items())})"
    each = [f"coalesce(CAST(floor(try_cast(get({amounts}, {i}) AS decimal(38, 9)) * try_element_at({sizes}, get({units}, {i}))) AS bigint), 0L)" for i in range(MOST_PIECES)]
    return f"CASE WHEN startswith({v}, '-') THEN -1L ELSE 1L END * ({' + '.join(each)})"


def _pieces(v: str, group: int) -> str:
    return f"regexp_extract_all({v}, r'{_PIECE}', {group})"


def event_time_ms(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with `name`: epoch milliseconds of an RFC 3339 text, or of a number of s, ms (from 1e12) or ns (from 1e17); null if it is neither."""
    own = rows.columns
    staged = rows.selectExpr("*", f"{_trimmed(column)} AS _v").selectExpr("*", f"{_number('_v')} AS _x")
    return staged.selectExpr(*own, f"coalesce({_stamp('_v')}, {_time_of_number('_x')}) AS {name}")


def duration_ns(rows: DataFrame, column: str, unit_ns: int, name: str) -> DataFrame:
    """rows with `name`: nanoseconds of a duration like 1h2m3.5s, or of a number of units; 0 if it is neither."""
    own = rows.columns
    staged = rows.selectExpr("*", f"{_trimmed(column)} AS _v").selectExpr("*", f"{_number('_v')} * {unit_ns} AS _x", f"CASE WHEN _v RLIKE {_DURATION} THEN _v END AS _t")
    staged = staged.selectExpr("*", f"{_pieces('_t', 1)} AS _amounts", f"{_pieces('_t', 2)} AS _units")
    return staged.selectExpr(*own, f"coalesce(CAST(round(_x) AS bigint), {_sum_of_pieces('_t', '_amounts', '_units')}, 0L) AS {name}")


def _details(d: str) -> dict[str, str]:
    f = lambda *paths: _first_nonzero(*[f"{d}.{p}" for p in paths])
    cached = ("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens")
    made = ("prompt_tokens_details.cache_write_tokens", "prompt_tokens_details.cache_creation_tokens", "input_tokens_details.cache_write_tokens", "input_tokens_details.cache_creation_tokens")
    return {
        "input_tokens": f("input_tokens", "prompt_tokens", "InputTokens"),
        "output_tokens": f("output_tokens", "completion_tokens", "OutputTokens"),
        "reasoning_tokens": f("reasoning_tokens", "completion_tokens_details.reasoning_tokens", "ReasoningTokens"),
        "cached_tokens": f("cached_tokens", *cached, "CachedTokens"),
        "cache_read_tokens": f("cache_read_tokens", "cache_read_input_tokens", *cached, "CacheReadTokens"),
        "cache_creation_tokens": f("cache_creation_tokens", "cache_creation_input_tokens", *made, "CacheCreationTokens"),
        "total_tokens": f("total_tokens", "TotalTokens"),
    }


#: Where a duration may stand and the nanoseconds of its unit; the first that isn't 0 counts.
DURATIONS = {
    "latency_ns": (("_snake.latency", 1), ("_snake.latency_ms", 1_000_000), ("_legacy.Latency", 1), ("_snake.LatencyMs", 1_000_000)),
    "ttft_ns": (("_snake.ttft", 1), ("_snake.ttft_ms", 1_000_000), ("_legacy.TTFT", 1), ("_snake.TTFTMs", 1_000_000)),
}


def decode_records(rows: DataFrame, column: str) -> DataFrame:
    """Usage records as columns, beside the other columns of `rows`: malformed, names, flags, requested_at_ms (null if missing), latency_ns, ttft_ns, status, tokens.

    Malformed are records that aren't JSON objects or have a field of a wrong type in either dialect.
    """
    others = [f"`{c}`" for c in rows.columns if c != column]
    snake, legacy = parse_record(F.col(column))
    parsed = rows.select(*others, F.col(column).alias("_record"), snake.alias("_snake"), legacy.alias("_legacy"))

    flag = lambda *fs: f"greatest({', '.join(f'coalesce({f}, false)' for f in fs)})"
    one, two = _details("_snake.detail"), _details("_legacy.Detail")
    picked = {
        "malformed": f"_snake IS NULL OR _snake.{_BAD} IS NOT NULL OR _legacy.{_BAD} IS NOT NULL OR NOT coalesce(startswith(ltrim(_record), '{{'), false)",
        **{n: _first_filled(f"_snake.{n}", f"_legacy.{PASCAL[n]}") for n in NAMES}, "base_url": _first_filled("_snake.base_url", "_snake.baseURL", "_legacy.BaseURL"),
        "stream": flag("_snake.stream", "_snake.streaming", "_legacy.Stream", "_legacy.Streaming"), "generate": flag("_snake.generate", "_legacy.Generate"), "failed": flag("_snake.failed", "_legacy.Failed"),
        "_time": _trimmed("coalesce(_snake.requested_at, _snake.requested_at_ms, _snake.RequestedAt, _snake.RequestedAtMs)"),
        **{f"_{name}_{i}": _trimmed(f) for name, fields in DURATIONS.items() for i, (f, _) in enumerate(fields)},
        **{f"_code_{i}": _first_nonzero(f"{s}.status_code", f"{s}.StatusCode") for i, s in enumerate(("_snake.failure", "_legacy.Failure"))},
        **{f"_body_{i}": _first_filled(f"{s}.body", f"get_json_object(_record, '$.{n}.Body')") for i, (s, n) in enumerate((("_snake.failure", "failure"), ("_legacy.Failure", "Failure")))},
        **{f"_one_{k}": v for k, v in one.items()}, **{f"_two_{k}": v for k, v in two.items()},
    }
    fields = parsed.selectExpr(*others, *[f"{v} AS {k}" for k, v in picked.items()])
    plain = ["malformed", *NAMES, "base_url", "stream", "generate", "failed"]

    first_code, first_detail = "_code_0 = 0 AND _body_0 = ''", " AND ".join(f"_one_{k} = 0" for k in one)
    read = {
        "_x": _number("_time"), "_stamp": _stamp("_time"), "status_code": f"CASE WHEN {first_code} THEN _code_1 ELSE _code_0 END", "failure": f"CASE WHEN {first_code} THEN _body_1 ELSE _body_0 END",
        "_legacy_detail": first_detail,
        **{f"_{name}_n{i}": f"CAST(round({_number(f'_{name}_{i}')} * {unit}) AS bigint)" for name, fs in DURATIONS.items() for i, (_, unit) in enumerate(fs)},
        **{f"_{name}_t{i}": f"_{name}_{i} RLIKE {_DURATION} AND _{name}_{i} RLIKE '[1-9]'" for name, fs in DURATIONS.items() for i, _ in enumerate(fs)},
    }
    texts = [f"_{name}_{i}" for name, fs in DURATIONS.items() for i, _ in enumerate(fs)]
    parts = [f"_{side}_{k}" for side in ("one", "two") for k in one]
    numbers = fields.selectExpr(*others, *plain, *texts, *parts, *[f"{v} AS {k}" for k, v in read.items()])

    def chosen(name: str, value: str) -> str:
        """`value` (with {i}) of the first spelling that isn't 0."""
        return "CASE " + " ".join(f"WHEN coalesce(_{name}_n{i}, 0L) <> 0 OR _{name}_t{i} THEN {value.format(i=i)}" for i in range(len(DURATIONS[name]))) + " END"

    settled = {
        "requested_at_ms": f"coalesce(_stamp, {_time_of_number('_x')})",
        **{f"_{name}_number": chosen(name, f"_{name}_n{{i}}") for name in DURATIONS}, **{f"_{name}_text": chosen(name, f"CASE WHEN _{name}_t{{i}} THEN _{name}_{{i}} END") for name in DURATIONS},
        **{k: f"CASE WHEN _legacy_detail THEN _two_{k} ELSE _one_{k} END" for k in one},
    }
    known = numbers.selectExpr(*others, *plain, "status_code", "failure", *[f"{v} AS {k}" for k, v in settled.items()])
    cut = known.selectExpr("*", *[f"{_pieces(f'_{name}_text', i)} AS _{name}_{kind}" for name in DURATIONS for i, kind in ((1, "amounts"), (2, "units"))])
    spans = [f"coalesce(_{name}_number, {_sum_of_pieces(f'_{name}_text', f'_{name}_amounts', f'_{name}_units')}, 0L) AS {name}" for name in DURATIONS]
    return cut.selectExpr(*others, *plain, "requested_at_ms", *spans, "status_code", "failure", *one)
