"""Streaming ingest of usage records."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from ..operators import events as ev
from ..sources.tables import UsageTables

#: Bits of an event id for the partition and the row within a batch; 31 are left for the batch.
PARTITION_BITS, ROW_BITS = 11, 21
BATCH_BITS = 63 - PARTITION_BITS - ROW_BITS


def record_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """JSON-lines files of usage records as a stream of `raw` texts; a Kafka value column works alike."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("raw"))


def batch_events(raw: DataFrame, batch_id: int, salt: str, ingest_ms: int) -> DataFrame:
    """Records as normalised events with a `malformed` flag and the raw text of malformed ones."""
    if not 0 <= batch_id < 1 << BATCH_BITS:
        raise ValueError(f"batch {batch_id} is beyond the range of event ids")
    # arrival order: the batch number, then partition and row, each in bits of its own
    position = F.monotonically_increasing_id()
    row = position.bitwiseAND(F.lit((1 << 33) - 1))
    place = F.shiftleft(F.shiftright(position, 33), ROW_BITS).bitwiseOR(row)
    checked = F.when(row < 1 << ROW_BITS, place).otherwise(F.raise_error(F.lit(f"a partition of a batch has more than {1 << ROW_BITS} records: take fewer files at a time")).cast("long"))
    numbered = raw.coalesce(1 << PARTITION_BITS).withColumn("id", checked + F.lit(batch_id << (PARTITION_BITS + ROW_BITS)).cast("long"))
    return ev.decode_usage(numbered.withColumn("_raw", F.col("raw")))


def write_micro_batch(tables: UsageTables, dead_letters: str, clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: events and rollups as one committed batch, malformed records aside. A replayed batch replaces itself."""

    def write(raw: DataFrame, batch_id: int) -> None:
        now = int(clock() * 1000)
        try:
            _write(raw, batch_id, now)
        except Exception as e:
            # the stream ends here and takes the batch again when it is started; what failed is counted
            tables.files.write(f"failures/{batch_id:012d}-{now}.json", {"batch": batch_id, "at_ms": now, "error": str(e)[:300]})
            raise

    def _write(raw: DataFrame, batch_id: int, now: int) -> None:
        # decoded once, and read from there by both writes and by the tables of distinct identities
        decoded = batch_events(raw, batch_id, tables.salt, now).persist(StorageLevel.DISK_ONLY)
        try:
            dropped = Observation()
            bad = decoded.where("malformed").select(F.col("_raw").alias("raw")).observe(dropped, F.count(F.lit(1)).alias("dropped"))
            bad.write.mode("overwrite").text(f"{dead_letters}/batch={batch_id}")
            events = ev.stored_events(decoded.where("not malformed"), tables.salt, F.lit(now))
            tables.write_batch(events, f"{batch_id:012d}", normalized=True, facts=dropped.get)
        finally:
            decoded.unpersist()

    return write


def ingest_stream(records: DataFrame, tables: UsageTables, checkpoint: str, dead_letters: str, every: str | None = None) -> StreamingQuery:
    """Starts the ingest of a stream of `raw` texts; without `every` it takes what is there and ends."""
    writer = records.writeStream.foreachBatch(write_micro_batch(tables, dead_letters)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def ingest_metrics(tables: UsageTables) -> dict:
    """Counters over the committed batches: accepted, dropped, batches, and size and time of the last one; and writes that failed."""
    last = F.max_by(F.struct(F.col("events").alias("last_batch_events"), F.col("took_ms").alias("last_batch_ms")), "written_ms").alias("_last")
    sums = tables.commits().agg(F.sum("events").alias("accepted"), F.sum("dropped").alias("dropped"), F.count(F.lit(1)).alias("batches"), last).select("accepted", "dropped", "batches", "_last.*").first()
    return {k: v or 0 for k, v in sums.asDict().items()} | {"write_failures": len(tables.files.names("failures"))}


class IngestListener(StreamingQueryListener):
    """Follows the streams of a session: for each query (by id) its batches, records read, time of the last batch and, when it failed, the error.

    spark.streams.addListener(IngestListener()); what was written is in ingest_metrics, whatever driver wrote it.
    """

    def __init__(self) -> None:
        self.queries: dict[str, dict] = {}

    def _of(self, query_id: object) -> dict:
        return self.queries.setdefault(str(query_id), {"batches": 0, "records": 0, "last_batch_ms": 0, "running": True, "error": None})

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._of(event.id)["running"] = True

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        own, progress = self._of(event.progress.id), event.progress
        if progress.numInputRows:
            own["batches"] += 1
            own["records"] += progress.numInputRows
            own["last_batch_ms"] = progress.batchDuration

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._of(event.id).update(running=False, error=event.exception)
