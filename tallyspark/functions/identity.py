"""Pseudonyms, masks and labels of identities, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_dimension, let, text, trim

#: Defaults of the two salts; jobs pass their own.
SALT = "tallyspark-salt"
PUBLIC_SALT = "tallyspark-public-label"
#: Words that name no credential. Fixed values.
NO_CREDENTIAL = ("unknown", "apikey", "api-key", "key", "credential", "auth", "oauth")


def pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads of a key."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def short_hmac(value: Column, salt: str) -> Column:
    """The first 16 hex digits of HMAC-SHA256."""
    inner, outer = pads(salt)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), text(value).cast("binary")), 256))
    return F.left(F.sha2(F.concat(F.lit(outer), digest), 256), F.lit(16))


def anonymous_label(prefix: str, digest: Column) -> Column:
    return let(trim(digest), lambda d: F.when(d == "", F.lit(f"{prefix}-unknown")).otherwise(F.concat(F.lit(f"{prefix}-"), F.left(d, F.lit(8)))))


def public_identifier(prefix: str, value: Column, salt: str = PUBLIC_SALT) -> Column:
    return let(trim(value), lambda v: F.when(v == "", F.lit(f"{prefix}-unknown")).otherwise(anonymous_label(prefix, short_hmac(v, salt))))


def is_hex_digest(value: Column) -> Column:
    return text(value).rlike(r"\A[0-9a-fA-F]{16}\z")


def first_filled(*values: Column) -> Column:
    """The first value that isn't blank, else the empty string."""
    return F.coalesce(*[F.when(trim(v) != "", v) for v in values], F.lit(""))


def clean_credential(value: Column) -> Column:
    out = trim(value)
    for suffix in ("json", "yaml", "yml"):
        out = F.regexp_replace(out, rf"\.{suffix}\z", "")
    return trim(out)


def mask_credential(value: Column) -> Column:
    def masked(v: Column) -> Column:
        n = F.char_length(v)
        return (
            F.when(n == 0, F.lit("unknown"))
            .when(n >= 6, F.concat(F.left(v, F.lit(3)), F.lit("***"), F.right(v, F.lit(2))))
            .when(n >= 3, F.concat(F.left(v, F.lit(1)), F.lit("***"), F.right(v, F.lit(1))))
            .otherwise(F.concat(F.left(v, F.lit(1)), F.lit("***")))
        )

    return let(clean_credential(value), masked)


def _one_separator(label: Column) -> Column:
    return trim(F.replace(text(label), F.lit(" · "), F.lit(" / ")))


def credential_from_source(provider: Column, source: Column) -> Column:
    """The credential that a source label names, else the empty string."""

    def of(label: Column, candidate: Column) -> Column:
        none = (candidate == "") | (F.lower(candidate) == F.lower(trim(provider))) | F.lower(candidate).isin(*NO_CREDENTIAL)
        known = label.contains(" / ") | candidate.contains("***") | candidate.contains("@") | (F.char_length(candidate) >= 10)
        return F.when(none | ~known, F.lit("")).otherwise(candidate)

    return let(_one_separator(source), lambda label: let(trim(F.substring_index(label, " / ", -1)), lambda candidate: of(label, candidate)))


def preferred_credential(auth_type: Column, auth_id: Column, auth_index: Column) -> Column:
    def of(kind: Column) -> Column:
        by_index = kind.contains("api") | kind.contains("key")
        return F.when(by_index, first_filled(auth_index, auth_id, kind)).otherwise(first_filled(auth_id, auth_index, kind))

    return let(F.lower(trim(auth_type)), of)


def credential_label(provider: Column, credential: Column, fallback: Column) -> Column:
    named = let(clean_credential(credential), lambda c: F.when(c == "", fallback).otherwise(c))
    return F.concat(clean_dimension(provider, "unknown"), F.lit(" / "), mask_credential(named))


def stored_label(provider: Column, credential: Column, stored: Column, fallback: Column) -> Column:
    """The label of a credential, or of a stored label if there is no credential."""

    def of(prefix: Column, own: Column) -> Column:
        rest = F.when(F.startswith(own, prefix), trim(F.substring(own, F.char_length(prefix) + 1, F.char_length(own)))).otherwise(own)
        return let(rest, lambda r: F.when((credential == "") & r.contains("***"), F.concat(prefix, r)).otherwise(credential_label(provider, F.when(credential == "", r).otherwise(credential), fallback)))

    prefix = F.concat(clean_dimension(provider, "unknown"), F.lit(" / "))
    return let(F.struct(prefix.alias("p"), trim(stored).alias("s")), lambda x: of(x["p"], x["s"]))


def masked_label(provider: Column, label: Column, fallback: Column) -> Column:
    """A stored label for display; labels of older rows may not be masked yet."""

    def of(whole: Column, last: Column) -> Column:
        several = whole.contains(" / ")
        owner = F.when(several & (trim(provider) == ""), F.substring_index(whole, " / ", 1)).otherwise(text(provider))
        masked = F.concat(clean_dimension(owner, "unknown"), F.lit(" / "), last)
        return F.when(several & last.contains("***"), masked).otherwise(credential_label(owner, F.when(several, last).otherwise(whole), fallback))

    return let(_one_separator(label), lambda whole: let(trim(F.substring_index(whole, " / ", -1)), lambda last: of(whole, last)))
