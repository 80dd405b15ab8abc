"""Identities worked out once for each distinct combination of what they hang on.

A batch has far fewer clients and accounts than events. The rules that pseudonymise and label them
(several HMACs, many text rules) are applied to the distinct combinations, which are counted in the
tasks before they are shuffled, and joined back on all the columns they hang on. The table is
broadcast if it has at most MOST_SENT rows by an estimate of 2 %; a larger one is joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a broadcast table; a row is some hundred bytes.
MOST_SENT = 200_000

Rule = Callable[[DataFrame], DataFrame]


def by_distinct(rows: DataFrame, rules: dict[tuple[str, ...], Rule], most_sent: int = MOST_SENT) -> DataFrame:
    """rows with the columns that each rule adds to a table of its key columns; a rule must hang on those alone.

    Estimates the combinations at once, by one pass that shuffles nothing; the tables are another pass, so what
    `rows` come from is read three times: persist it where that is dear.
    """
    sizes = rows.agg(*[F.approx_count_distinct(F.xxhash64(*keys), 0.02) for keys in rules]).first()
    out = rows
    for (keys, rule), size in zip(rules.items(), sizes, strict=True):
        ruled = rule(rows.select(*keys).distinct())
        made = [c for c in ruled.columns if c not in keys]
        table = ruled.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *made)
        same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(table[f"_of_{k}"]) for k in keys])
        out = out.join(F.broadcast(table) if size <= most_sent else table, same).drop(*[f"_of_{k}" for k in keys])
    return out
