"""Column functions against plain Python and known values."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import decode, identity, text

WHITE = "\t\n\x0b\x0c\r \x85\xa0       　"


def strip_controls(s):
    return re.sub("[\x00-\x1f\x7f-\x9f]", "", s)


def applied(spark, values, f):
    rows = f(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def apply(spark, values, f):
    return applied(spark, values, lambda rows: rows.select("i", f(F.col("v")).alias("o")))


def clean(s, fallback="unknown"):
    s = s.strip(WHITE)
    if not s:
        return fallback
    raw = s.encode()
    if len(raw) > 160:
        cut = raw[:160]
        good = cut.decode("utf-8", "ignore")
        s = good + "�" * (160 - len(good.encode()))
    return strip_controls(s)


def failure(s):
    return strip_controls(s.strip(WHITE).encode()[:512].decode("utf-8", "ignore"))


def random_texts(n=120):
    r = random.Random(3)
    alphabet = "ab /·.*@é日🙂\t\n\x85\x9f\x00　 " + "xyz"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 260))) for _ in range(n)] + ["", " ", "é" * 300, "🙂" * 200, "a" * 159 + "é", "a" * 158 + "🙂", "a" * 511 + "日"]


def test_clean_dimension_and_failure(spark):
    values = random_texts()
    assert apply(spark, values, lambda c: text.clean_dimension(c, "unknown")) == [clean(v) for v in values]
    assert apply(spark, values, text.sanitize_failure) == [failure(v) for v in values]


def mask(v):
    v = v.strip(WHITE)
    for s in (".json", ".yaml", ".yml"):
        v = v.removesuffix(s)
    v = v.strip(WHITE)
    n = len(v)
    return "unknown" if not n else v[:3] + "***" + v[-2:] if n >= 6 else v[0] + "***" + v[-1] if n >= 3 else v[0] + "***"


def test_masks(spark):
    known = ["c0ffee11d00dfeed", "someone@firm.example", "key-of-nobody-42", "sixsix", "fives", "abc", "ab", "7", "", "cd.yml.json", " .yaml"]
    assert apply(spark, known, identity.mask_credential) == [mask(v) for v in known]
    assert mask("sixsix") == "six***ix" and mask("fives") == "f***s" and mask("7") == "7***" and mask("") == "unknown"
    values = random_texts()
    assert apply(spark, values, identity.mask_credential) == [mask(v) for v in values]


def test_hmac(spark):
    for salt in ("salt", "s" * 100, ""):
        values = ["", "abc", "é" * 50]
        assert apply(spark, values, lambda c: identity.short_hmac(c, salt)) == [hmac.new(salt.encode(), v.encode(), hashlib.sha256).hexdigest()[:16] for v in values]


@pytest.mark.parametrize(
    "value, path",
    [
        ("https://gate.test:8443/v2/who%40firm.example/run%2Fnow?k=v&x=%zz#part", "/v2/who@firm.example/run/now"),
        ("/v2/run", "/v2/run"), ("", ""), ("  /a+b%20c ", "/a+b c"), ("/a b/{x}", "/a b/{x}"), ("mailto:x@y", ""), ("a:b/c", ""), ("v1/x", "v1/x"), (":x", ""), ("/a%zz", ""), ("/a%0Ab", "/ab"),
        ("//host/p", "/p"), ("///p", "///p"), ("http://h:80a/p", ""), ("http://h o/p", ""), ("/x\ny", ""), ("/p#%zz", ""), ("/" + "é" * 200, "/" + "é" * 127),
    ],
)
def test_endpoints(spark, value, path):
    assert apply(spark, [value], text.sanitize_endpoint) == [path]


def test_labels(spark):
    rows = [
        ("north", "north · someone@firm.example.json", "north / som***le"), ("north", "north / rin***7x", "north / rin***7x"), ("", "crew / quitequiet", "crew / qui***et"),
        ("north", "", "north / ins***ad"), ("north", "tiny", "north / t***y"), (" ", "x", "unknown / x***"),
    ]
    df = spark.createDataFrame(rows, "p string, l string, want string")
    assert all(r.got == r.want for r in df.select("want", identity.masked_label(F.col("p"), F.col("l"), F.lit("instead")).alias("got")).collect())
    sources = {"": "", "unknown": "", "north": "", "brief": "", "name-of-some-length": "name-of-some-length", "a · b": "b", "x@y": "x@y", "a***b": "a***b", "t / OAuth": ""}
    df = spark.createDataFrame(list(sources.items()), "s string, want string")
    assert all(r.got == r.want for r in df.select("want", identity.credential_from_source(F.lit("NORTH"), F.col("s")).alias("got")).collect())


def test_like_is_case_blind_for_ascii_only(spark):
    values = ["ORION-4", "orion_4", "É", "é", "a\\b", "ab"]
    hits = lambda p: [v for v, h in zip(values, apply(spark, values, lambda c: text.like_ascii(c, p)), strict=True) if h]
    assert hits("orion_4") == ["ORION-4", "orion_4"] and hits("É") == ["É"] and hits("a\\b") == ["a\\b"] and hits("%B") == ["a\\b", "ab"]


def test_times(spark):
    known = {
        "2025-03-12T12:00:00Z": 1741780800000, "2025-03-12T12:00:00.1234567Z": 1741780800123, "2025-03-12T20:00:00+08:00": 1741780800000, "1741780800": 1741780800000, "1741780800.5": 1741780800500,
        "1741780800123": 1741780800123, "1741780800123000000": 1741780800123, "2023": 2023000, "1.7e9": 1700000000000, "0": None, "": None, "soon": None, "NaN": None, "-5": -5000, "2023-13-01T00:00:00Z": None,
    }
    assert dict(zip(known, applied(spark, list(known), lambda rows: decode.event_time_ms(rows, "v", "o")), strict=True)) == known


def test_durations(spark):
    ms = 1_000_000
    known = {"220ms": 220 * ms, "1h2m3.5s": 3723500 * ms, "1.5us": 1500, "1.5µs": 1500, "-2s": -2000 * ms, "5": 5 * ms, "0.25": ms // 4, "": 0, "x": 0, "1s2": 0, "ms": 0, "3ms2h1ms": (7200_000 + 4) * ms, "1h" * 9: 0, "100ns": 100, ".5s": 500 * ms}
    assert dict(zip(known, applied(spark, list(known), lambda rows: decode.duration_ns(rows, "v", ms, "o")), strict=True)) == known
