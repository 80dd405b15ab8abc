"""Exact deduplication with a heavy-hitter split.

1. Every text is reduced to the SHA-256 digest of its normal form (each run of white
   space becomes one space; null counts as empty). The narrow table of digests is
   written once to the shared folder.
2. Misra-Gries summaries with `counters` counters, one per partition, are added up. A
   digest is a candidate if its summed count reaches rows / (counters + 1); by the
   Misra-Gries bound there are at most counters + 1 of those, and every digest of more
   than 2 rows / (counters + 1) rows is among them.
3. The candidates' true counts and smallest ids are verified by a partly pre-aggregated
   count. This table of at most counters + 1 rows is broadcast: copies of frequent texts
   are resolved where they are read.
4. The other digests, now in groups of a bounded share of the rows, are shuffled.

Null ids count as larger than others; a group that has only null ids has a null keep_id,
and its rows are marked kept. Rows that repeat both id and text are marked alike;
`drop_copies` keeps one of them. An empty table gives an empty result. Other columns are
passed on by `drop_copies` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free_name, quoted, ship, text_of

#: Misra-Gries counters of a partition; also the bound on what is broadcast.
COUNTERS = 1024


def normal_text(column: str = "text"):
    return F.regexp_replace(text_of(column), SPACE, " ")


def frequent_counts(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The Misra-Gries summary of the digests of one partition."""
    held: dict[str, int] = {}
    for batch in batches:
        for x in batch.column(0).value_counts():
            digest, n = x["values"].as_py(), x["counts"].as_py()
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            # take away the (counters + 1)-th largest count from all, as so many single decrements would
            least = sorted(held.values(), reverse=True)[counters]
            held = {k: v - least for k, v in held.items() if v > least}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["text_sha256", "seen"])


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified frequent digests (at most counters + 1): text_sha256, keep_id, group_size."""
    ship(digests.sparkSession)
    rows = digests.count()
    summary = digests.select("text_sha256").mapInArrow(lambda it: frequent_counts(it, counters), "text_sha256 string, seen long")
    floor = max(2, -(-rows // (counters + 1)))
    candidates = summary.groupBy("text_sha256").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= floor).select("text_sha256")
    return (
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(docs.select("doc_id", F.sha2(normal_text(), 256).alias("text_sha256")), "digests")
    heavy = scratch.keep(heavy_digests(digests, counters), "heavy")
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    done = marked.where(F.col("group_size").isNotNull())
    rest = marked.where(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    smallest = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = rest.join(smallest, "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"]
    return done.select(*columns).unionByName(light.select(*columns))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, one row of each group, with all their columns."""
    own_id, sha, rows = (free_name(docs, n) for n in ("kept_id", "kept_sha", "kept_rows"))
    kept = exact_groups(docs.select("doc_id", "text"), counters).where("kept")
    kept = kept.groupBy(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias(rows))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.sha2(normal_text(), 256) == F.col(sha)))
    columns = [quoted(c) for c in docs.columns]
    single = joined.where(F.col(rows) == 1).select(*columns)
    repeated = joined.where(F.col(rows) > 1).dropDuplicates([own_id, sha]).select(*columns)
    return single.unionByName(repeated)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
