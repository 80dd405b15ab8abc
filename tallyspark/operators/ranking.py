"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: monotonically_increasing_id has a row's place in its partition in these bits, the partition above them.
_ROW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with the long column `name`, their rank from 1 in a total `order`, within each value of the columns `within`.

    Rows are dealt by ranges of the order, sorted in their partitions and written to the shared folder, as
    ranges are drawn anew whenever a plan runs. A rank is a row's place in its partition and the rows of the
    partitions before it: of those counts the driver adds up one for each partition and value of `within`,
    which is meant for few values (distributions, kinds).
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    kept = Scratch(spark, "ranked").keep(dealt.withColumn("_place", F.monotonically_increasing_id()), "rows")
    numbered = kept.withColumns({"_part": F.shiftright("_place", _ROW_BITS), "_place": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    counts = numbered.groupBy("_part", *within).agg(F.min("_place"), F.count(F.lit(1))).collect()
    before: dict[tuple, int] = {}
    offsets = []
    for part, *group, first, n in sorted(counts, key=lambda c: c[0]):
        offsets.append((part, *group, before.get(tuple(group), 0) - first + 1))
        before[tuple(group)] = before.get(tuple(group), 0) + n
    kinds = "".join(f", _in_{i} {rows.schema[w].dataType.simpleString()}" for i, w in enumerate(within))
    places = spark.createDataFrame(offsets, f"_of long{kinds}, _offset long")
    same = F.col("_part") == F.col("_of")
    for i, w in enumerate(within):
        same = same & F.col(w).eqNullSafe(F.col(f"_in_{i}"))
    # a row for each partition and value
    out = numbered.join(F.broadcast(places), same)
    return out.select(*rows.columns, (F.col("_place") + F.col("_offset")).alias(name))
