"""Prices and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, trim
from ..sources.schema import RATES

MOST_PRICES = 2000
MOST_RATE = 1_000_000.0


def resolve_prices(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Adds the rates of each row's model: its own, that of the text after the last slash, that of `*`, or zeros.

    A row that is found counts as found whatever its rates. Prices are at most MOST_PRICES
    rows (see validate_prices), so they are broadcast; rows should be aggregated already.
    """
    found = F.struct(*RATES)
    exact = prices.select(F.col("model").alias("_m1"), found.alias("_p1"))
    tail = prices.select(F.col("model").alias("_m2"), found.alias("_p2"))
    other = prices.where(F.col("model") == "*").select(F.lit("*").alias("_m3"), found.alias("_p3"))
    suffix = F.when(F.col(model).contains("/"), F.substring_index(F.col(model), "/", -1))
    out = rows.withColumns({"_suffix": suffix, "_any": F.when(F.col(model).isNotNull(), F.lit("*"))})
    out = out.join(F.broadcast(exact), F.col(model) == F.col("_m1"), "left").join(F.broadcast(tail), F.col("_suffix") == F.col("_m2"), "left").join(F.broadcast(other), F.col("_any") == F.col("_m3"), "left")
    price = F.coalesce("_p1", "_p2", "_p3")
    matched = F.when(F.col("_p1").isNotNull(), "exact").when(F.col("_p2").isNotNull(), "suffix").when(F.col("_p3").isNotNull(), "wildcard").otherwise("none")
    return out.select(*[F.col(c) for c in rows.columns], matched.alias("price_match"), *[F.coalesce(price[r], F.lit(0.0)).alias(r) for r in RATES])


def cost(cache_read_rate: str = "cache_read_per_million") -> Column:
    """Dollars of a row's tokens at its rates, from disjoint classes of tokens, none below 0."""
    part = lambda x: F.greatest(x, F.lit(0))
    read, write, thought = (part(F.col(x)) for x in ("cache_read_tokens", "cache_creation_tokens", "reasoning_tokens"))
    fallback = lambda rate, other: F.when(F.col(rate) == 0, F.col(other)).otherwise(F.col(rate))
    units = (
        part(F.col("input_tokens") - read - write) * F.col("input_per_million")
        + part(F.col("output_tokens") - thought) * F.col("output_per_million")
        + read * F.col(cache_read_rate)
        + write * fallback("cache_write_per_million", "input_per_million")
        + thought * fallback("reasoning_per_million", "output_per_million")
    )
    return units / F.lit(1_000_000.0)


def with_costs(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd, and standard_cost_usd, in which cache reads cost as much as input."""
    return resolve_prices(rows, prices).withColumns({"cost_usd": cost(), "standard_cost_usd": cost("input_per_million")}).drop(*RATES, "price_match")


def price_list(prices: DataFrame) -> DataFrame:
    return prices.orderBy(fold_ascii(F.col("model")), "model")


def validate_prices(prices: DataFrame) -> DataFrame:
    """Each submitted price with the trimmed model and the first reason against it (null: valid)."""
    name = trim(F.col("model"))
    same = F.count(F.lit(1)).over(Window.partitionBy("model"))
    bad = None
    for r in RATES:
        own = F.col(r).isNull() | F.isnan(r) | (F.col(r) < 0) | (F.col(r) > MOST_RATE)
        bad = own if bad is None else bad | own
    rows = prices.withColumn("model", name)
    reason = F.when((F.col("model") == "") | (F.octet_length("model") > 160), "name").when(same > 1, "duplicate").when(bad, "rate")
    return rows.withColumn("reason", reason)


def check_prices(prices: DataFrame) -> None:
    """Raises if a price list may not be stored."""
    rows = prices.limit(MOST_PRICES + 1).count()
    if rows > MOST_PRICES:
        raise ValueError(f"a price list may have {MOST_PRICES} models at most")
    bad = validate_prices(prices).where("reason is not null").orderBy("model").first()
    if bad is not None:
        raise ValueError(f"model price {bad['model']!r}: {bad['reason']}")
