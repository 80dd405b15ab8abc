"""A live rollup: minute sums by all five dimensions, kept in streaming state and upserted to a table.

The state has a row for each minute and each combination of dimensions, so it is as large as the
rollups of the retention: run it with the RocksDB state store. Each micro-batch gives the whole
values of the keys that it changed (update mode), and these go to a folder of their own. A batch
that is replayed has the same input and the same state before it, hence the same rows, so a batch
that is there stays as it is: what was readable is never hidden. The latest batch of a key is its
value, and `compact` folds batches into one. Labels are those of the latest event, decided in the
state, so neither the split into batches nor the order of arrival changes a value.

Records that a client sent twice can be dropped before, by `distinct_records`. That is a stage of its own with
its own checkpoint: it writes the records that it keeps, and ingest and the live rollup read those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import identity
from ..operators import events as ev
from ..operators.rollups import LAST, measures
from ..sources.files import Files
from ..sources.schema import MEASURES, ROLLUP_KEYS, ROLLUP_LABELS
from ..sources.tables import ROLLUP_SCHEMA

DIMENSIONS = tuple(k for k in ROLLUP_KEYS if k != "minute")


def live_rollup(records: DataFrame, retention_days: int = 30, salt: str = identity.SALT) -> DataFrame:
    """Minute rollups of a stream of `raw` texts: the keys, labels and measures of minute_rollup, in update mode.

    An `id` of the records (a Kafka offset, say) is their order at equal times. Records later than
    the retention are dropped, and their state goes with them.
    """
    numbered = records if "id" in records.columns else records.withColumn("id", F.lit(0).cast("long"))
    decoded = ev.decode_usage(numbered.select("id", "raw")).where("not malformed")
    events = ev.normalize_events(ev.compact_events(decoded, salt), salt).withColumn("_at", F.timestamp_millis("timestamp_ms"))
    groups = events.withWatermark("_at", f"{retention_days} days").groupBy(F.window("_at", "1 minute").alias("_minute"), *DIMENSIONS)
    sums = groups.agg(*[F.max_by(x, F.struct(*LAST, x)).alias(x) for x in ROLLUP_LABELS], *[v.alias(m) for m, v in measures().items()])
    minute = F.expr("unix_millis(_minute.start) div 60000")
    return sums.select(minute.alias("minute"), *[c for c in (*ROLLUP_KEYS, *ROLLUP_LABELS, *MEASURES) if c != "minute"])


class LiveTable:
    """The table that a live rollup is upserted to.

    root/changes/batch=<n>/event_date=<date>: what batch n changed; root/base/batch=<n>/...: all up to
    batch n. Folders count once Spark has marked them as written.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _written(self, kind: str) -> list[int]:
        """Numbers of the batches that are there as a whole."""
        found = [int(n.partition("=")[2]) for n in self.files.names(kind) if n.startswith("batch=")]
        return sorted(n for n in found if self.files.exists(f"{kind}/batch={n}/_SUCCESS"))

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        day = F.date_from_unix_date(F.expr("cast(minute div 1440 as int)"))
        rows.select(*ROLLUP_SCHEMA.names, day.alias("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(f"{self.root}/{kind}/batch={batch}")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """A foreachBatch function: whole values of changed keys. A batch that is there or already folded stays."""
        if batch not in self._written("changes") and batch > max(self._written("base"), default=-1):
            self._write(rows, "changes", batch)
        else:
            # the rows must be worked out all the same, as that brings the state to this batch
            rows.write.format("noop").mode("overwrite").save()

    def rollups(self) -> DataFrame:
        """The value of each key, with event_date; a query's conditions on minute and event_date prune days."""
        base = max(self._written("base"), default=-1)
        chosen = {"base": [base] if base >= 0 else [], "changes": [n for n in self._written("changes") if n > base]}
        schema = T.StructType([*ROLLUP_SCHEMA.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.LongType())])
        rows = self.spark.createDataFrame([], schema)
        for kind, batches in chosen.items():
            if batches:
                rows = rows.unionByName(self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/batch={n}" for n in batches]))
        value = F.max_by(F.struct(*ROLLUP_LABELS, *MEASURES), "batch").alias("_value")
        return rows.groupBy(*ROLLUP_KEYS, "event_date").agg(value).select(*ROLLUP_KEYS, "_value.*", "event_date").select(*ROLLUP_SCHEMA.names, "event_date")

    def compact(self) -> None:
        """Folds all batches into one folder. What was folded is deleted by the next call, as readers may still be at it."""
        folded, changes = self._written("base"), self._written("changes")
        last = max(folded, default=-1)
        for n in folded[:-1]:
            self.files.delete(f"base/batch={n}")
        for n in changes:
            if n <= last:
                self.files.delete(f"changes/batch={n}")
        if changes and changes[-1] > last:
            self._write(self.rollups(), "base", changes[-1])


def live_stream(records: DataFrame, table: LiveTable, checkpoint: str, retention_days: int = 30, salt: str = identity.SALT, every: str | None = None) -> StreamingQuery:
    """Starts the live rollup of a stream of `raw` texts; without `every` it takes what is there and ends."""
    writer = live_rollup(records, retention_days, salt).writeStream.outputMode("update").foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def distinct_records(records: DataFrame, key: Column | None = None, within: str = "1 hour") -> DataFrame:
    """A stream of `raw` texts without those whose `key` (the whole text, if not given) came before, up to `within` earlier.

    Time is that of arrival (of the micro-batch, which a replay keeps), as a record's own time may be
    missing or wrong and would then make others late. Append mode only, as the state goes by
    watermark; write it out (`distinct_stream`) and read that on.
    """
    keyed = records.withColumn("_key", F.sha2(F.col("raw"), 256) if key is None else F.coalesce(key.cast("string"), F.sha2(F.col("raw"), 256)))
    arrived = keyed.withColumn("_at", F.current_timestamp()).withWatermark("_at", within)
    return arrived.dropDuplicatesWithinWatermark(["_key"]).select(*records.columns)


def distinct_stream(records: DataFrame, to: str, checkpoint: str, key: Column | None = None, within: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Starts writing the distinct records as text files to the folder `to`, each once."""
    kept = distinct_records(records, key, within).select(F.col("raw").alias("value"))
    writer = kept.writeStream.format("text").outputMode("append").option("path", to).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
