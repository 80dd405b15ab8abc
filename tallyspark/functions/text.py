"""Byte-exact text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(*spans: int | tuple[int, int]) -> str:
    return "".join(chr(c) for x in spans for c in (range(x[0], x[1] + 1) if isinstance(x, tuple) else (x,)))


#: Unicode white space and control characters. Fixed values.
WHITE = _chars((0x09, 0x0D), 0x20, 0x85, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTROL = _chars((0x00, 0x1F), (0x7F, 0x9F))
DIMENSION_BYTES = 160
ENDPOINT_BYTES = 256
FAILURE_BYTES = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used; keeps nested rules small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Strips Unicode white space from both ends."""
    return F.btrim(text(c), F.lit(WHITE))


def strip_controls(c: Column) -> Column:
    return F.translate(c, CONTROL, "")


def _valid_bytes(c: Column, limit: int) -> tuple[Column, Column]:
    """The longest valid text within the first `limit` bytes, and how many of those bytes it leaves out."""
    raw = c.cast("binary")
    cut = lambda n: F.substring(raw, 1, n).cast("string")
    out, left = cut(limit - 3), F.lit(3)
    for k in (2, 1, 0):
        ok = F.is_valid_utf8(cut(limit - k))
        out, left = F.when(ok, cut(limit - k)).otherwise(out), F.when(ok, F.lit(k)).otherwise(left)
    return out, left


def cut_bytes(c: Column, limit: int) -> Column:
    """At most `limit` bytes, without a character that would be cut."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(_valid_bytes(c, limit)[0])


def cut_bytes_marked(c: Column, limit: int) -> Column:
    """At most `limit` bytes; each byte of a cut character becomes U+FFFD."""
    out, left = _valid_bytes(c, limit)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(out, F.repeat(F.lit("�"), left)))


def clean_dimension(c: Column, fallback: str = "") -> Column:
    return let(trim(c), lambda value: F.when(value == "", F.lit(fallback)).otherwise(strip_controls(cut_bytes_marked(value, DIMENSION_BYTES))))


def sanitize_failure(c: Column) -> Column:
    return let(trim(c), lambda value: strip_controls(cut_bytes(value, FAILURE_BYTES)))


def sanitize_endpoint(c: Column) -> Column:
    """The decoded path of a url or path; empty if it isn't a valid one."""
    bad_escape = r"%(?![0-9A-Fa-f]{2})"

    def of_value(value: Column) -> Column:
        before = F.substring_index(value, "#", 1)
        fragment = F.substring(value, F.char_length(before) + 1, F.char_length(value))
        scheme = F.regexp_extract(before, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
        rest = F.substring_index(F.substring(before, F.when(scheme == "", 1).otherwise(F.char_length(scheme) + 2), F.char_length(before)), "?", 1)
        bad = value.rlike(r"[\x00-\x1F\x7F]") | before.startswith(":") | fragment.rlike(bad_escape)
        return F.when(bad, F.lit("")).otherwise(let(F.struct(scheme.alias("scheme"), rest.alias("rest")), lambda x: of_rest(x["scheme"], x["rest"])))

    def of_rest(scheme: Column, rest: Column) -> Column:
        has_authority = rest.startswith("//") & ((scheme != "") | ~rest.startswith("///"))
        authority = F.regexp_extract(rest, r"\A//([^/]*)", 1)
        path = F.when(has_authority, F.substring(rest, F.char_length(authority) + 3, F.char_length(rest))).otherwise(rest)
        host = F.regexp_extract(authority, r"([^@]*)\z", 1)
        bad_host = host.rlike(r"""[ "<>\\^`{|}%]|:[^\]:]*[^0-9\]:][^\]:]*\z""")
        bad = (~rest.startswith("/") & ((scheme != "") | F.substring_index(rest, "/", 1).contains(":"))) | (has_authority & bad_host)
        return F.when(bad, F.lit("")).otherwise(let(path, of_path))

    def of_path(path: Column) -> Column:
        # a plus sign is a plain character in a path
        decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
        return F.when(path.rlike(bad_escape), F.lit("")).otherwise(let(strip_controls(text(decoded)), lambda p: cut_bytes(p, ENDPOINT_BYTES)))

    return let(trim(c), of_value)


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only; backslashes are plain characters."""
    folded = pattern.translate({i: i + 32 for i in range(65, 91)})
    return fold_ascii(c).like(folded.replace("\\", "\\\\"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
