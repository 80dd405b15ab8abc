"""The stored tables: events, partial minute rollups and prices as Parquet, with a manifest.

A batch writes its events and its rollups to folders of its own and then a commit file;
readers see committed batches only, so both land together or not at all. Writing a batch again is
a further attempt with folders of its own (`<batch>@<attempt>`), and its commit takes the place of the one before: at
no time is a committed batch hidden, and a writer lost on the way leaves what was there. Folders are cut by event_date (UTC), on which ranges prune; how many files
a day gets follows its size. Rollups of batches are partial and are added up when read. The
`state-<n>.json` of the largest number names the generation of the tables and the version of
the prices: restore and compaction write a new generation beside the old one and then a new
state, so what is read is the old or the new tables, also if the writer is lost in between. Retention is a horizon in the state that readers
apply, and folders of days wholly before it are deleted.

  root/state-<n>.json
  root/gen-<g>/commits/<batch>[@<attempt>].json
  root/gen-<g>/events/batch=<batch>[@<attempt>]/event_date=<date>/*.parquet
  root/gen-<g>/rollups/batch=<batch>[@<attempt>]/event_date=<date>/*.parquet
  root/gen-<g>/tiers/batch=<batch>[@<attempt>]/event_date=<date>/tier=<minutes>/*.parquet
  root/prices/v<v>/*.parquet

Tiers are the batch's rollups added up by the hour and the day, without labels; `sums` answers a range
from the coarsest that fits. Commits tell the events of each day, by which pages find their days.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity
from ..operators import events as ev
from ..operators import paging, pricing, rollups
from ..operators.ranges import DAY, MINUTE, TimeRange
from .files import Files
from .schema import BACKUP_SCHEMA, EVENT_COLUMNS, EVENT_SCHEMA, MEASURES, PRICE_SCHEMA, ROLLUP_KEYS, ROLLUP_LABELS

ROLLUP_SCHEMA = T.StructType([T.StructField(k, T.LongType() if k == "minute" else T.StringType()) for k in (*ROLLUP_KEYS, *ROLLUP_LABELS)] + [T.StructField(m, T.LongType()) for m in MEASURES])
TIER_SCHEMA = T.StructType([*[f for f in ROLLUP_SCHEMA.fields if f.name not in ROLLUP_LABELS], T.StructField("tier", T.IntegerType())])
MOST_RESTORED = 1_000_000
#: Events of a day that are added up in one task.
SLICE = 100_000
_PARTITIONS = [T.StructField("batch", T.StringType()), T.StructField("event_date", T.DateType())]


class UsageTables:
    def __init__(self, spark: SparkSession, root: str, salt: str = identity.SALT):
        self.spark, self.root, self.salt = spark, root.rstrip("/"), salt
        self.files = Files(spark, self.root)

    def state(self) -> dict:
        return self.files.latest("state") or {"generation": 0, "prices": 0, "horizon_ms": None}

    def _folder(self, name: str, generation: int | None = None) -> str:
        g = self.state()["generation"] if generation is None else generation
        return f"gen-{g}/{name}"

    def _attempts(self, generation: int | None = None) -> dict[str, int]:
        """The last committed attempt of each batch."""
        found: dict[str, int] = {}
        for name in self.files.names(self._folder("commits", generation)):
            if name.endswith(".json"):
                batch, _, attempt = name.removesuffix(".json").partition("@")
                found[batch] = max(found.get(batch, 0), int(attempt or 0))
        return found

    def batches(self) -> list[str]:
        return sorted(self._attempts())

    @staticmethod
    def _named(batch: str, attempt: int) -> str:
        return f"{batch}@{attempt}" if attempt else batch

    def commits(self) -> DataFrame:
        """What the last attempt of each batch wrote at commit: one scan of small files, however many there are."""
        schema = "batch string, attempt int, events long, rollups long, dropped long, written_ms long, took_ms long, days map<string, long>"
        folder = self._folder("commits")
        if not self._attempts():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/{folder}")
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), F.coalesce("attempt", F.lit(0))).alias("_last")
        return rows.groupBy("batch").agg(last).select("batch", "_last.*")

    # writing

    def write_batch(self, events: DataFrame, batch: str, generation: int | None = None, normalized: bool = False, facts: dict | None = None) -> dict:
        """Writes events and their rollups as one batch and commits them; the same batch again replaces itself. What is written is counted as it is written."""
        if "@" in batch:
            raise ValueError("a batch's name has no @")
        began = time.time()
        g = self.state()["generation"] if generation is None else generation
        before = self._attempts(g).get(batch)
        attempt = 0 if before is None else before + 1
        name = self._named(batch, attempt)
        rows = events if normalized else ev.normalize_events(events, self.salt)
        day = F.to_date(F.timestamp_millis("timestamp_ms"))
        to = f"{self.root}/{self._folder(f'events/batch={name}', g)}"
        seen, summed = Observation(), Observation()
        # rebalancing splits a large day and merges small ones by their sizes
        dealt = rows.select(*EVENT_COLUMNS, day.alias("event_date")).hint("rebalance", "event_date").sortWithinPartitions("event_date", "timestamp_ms")
        dealt.observe(seen, F.count(F.lit(1)).alias("events")).write.mode("overwrite").partitionBy("event_date").parquet(to)
        # the rollups are of what was written, so both tables agree even if the source would not give the same rows again
        written = self.spark.read.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])).parquet(to)
        # rows of whole files by folder: footers are read, no columns
        days = {str(r.event_date or ""): r.n for r in written.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).collect()}
        to = f"{self.root}/{self._folder(f'rollups/batch={name}', g)}"
        day = F.date_from_unix_date(F.expr(f"cast(timestamp_ms div {MINUTE} div 1440 as int)"))
        own = self._by_day(written.withColumn("event_date", day), days, rollups.minute_rollup)
        own.observe(summed, F.count(F.lit(1)).alias("rollups")).write.mode("overwrite").partitionBy("event_date").parquet(to)
        minutes = self.spark.read.schema(T.StructType([*ROLLUP_SCHEMA.fields, _PARTITIONS[1]])).parquet(to)
        tiers = self._by_day(minutes, days, rollups.coarser_rollups).sortWithinPartitions("event_date", "tier", "minute")
        tiers.write.mode("overwrite").partitionBy("event_date", "tier").parquet(f"{self.root}/{self._folder(f'tiers/batch={name}', g)}")
        done = {"batch": batch, "attempt": attempt, "events": seen.get["events"], "rollups": summed.get["rollups"], "written_ms": int(time.time() * 1000), "took_ms": int((time.time() - began) * 1000), "days": days} | (facts or {})
        self.files.write(self._folder(f"commits/{name}.json", g), done)
        # the attempt before may still be read; those before it go
        if before is not None:
            self.files.delete(self._folder(f"commits/{self._named(batch, before)}.json", g))
            for old in range(before):
                for table in ("events", "rollups", "tiers"):
                    self.files.delete(self._folder(f"{table}/batch={self._named(batch, old)}", g))
        return done

    def _by_day(self, rows: DataFrame, days: dict[str, int], added: Callable[..., DataFrame]) -> DataFrame:
        """What `added` makes of rows with event_date and the rollups' keys, added up where the rows are dealt to once: by day and slice of the keys.

        All minutes, hours and days of a slice are in one task, and what it adds up is in the order it is written in.
        Slices and tasks follow the events of the largest day and of all days.
        """
        slices = 1 + max(days.values(), default=0) // SLICE
        tasks = min(slices * max(len(days), 1), max(self.spark.sparkContext.defaultParallelism, 1 + sum(days.values()) // SLICE))
        sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*[k for k in ROLLUP_KEYS if k != "minute"]), F.lit(slices)))
        return added(sliced.repartition(tasks, "event_date", "_slice"), by=("event_date", "_slice")).drop("_slice")

    # reading

    def _read(self, name: str, schema: T.StructType, only: set[str] | None = None) -> DataFrame:
        """A table's committed batches, or those of some folders."""
        base = f"{self.root}/{self._folder(name)}"
        found = [f"batch={self._named(b, n)}" for b, n in sorted(self._attempts().items())]
        paths = [f"{base}/{x}" for x in found if only is None or x in only]
        full = T.StructType([*schema.fields, *_PARTITIONS])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths)

    def events(self, with_batch: bool = False) -> DataFrame:
        """Committed events within the horizon; columns that older files lack are empty."""
        out = self._read("events", EVENT_SCHEMA)
        horizon = self.state()["horizon_ms"]
        if horizon is not None:
            first = F.date_from_unix_date(F.lit(horizon // DAY).cast("int"))
            out = out.where((F.col("timestamp_ms") >= horizon) & (F.col("event_date") >= first))
        blank = {"endpoint": F.coalesce("endpoint", F.lit(""))}
        columns = [*EVENT_COLUMNS, "event_date", *(["batch"] if with_batch else [])]
        return out.withColumns(blank).select(*columns)

    def partial_rollups(self) -> DataFrame:
        """Rollups as the batches wrote them, several rows for a key: for all that adds up measures and needs no labels. The horizon's minute is kept as a whole."""
        out = self._read("rollups", ROLLUP_SCHEMA)
        horizon = self.state()["horizon_ms"]
        if horizon is not None:
            first = F.date_from_unix_date(F.lit(horizon // DAY).cast("int"))
            out = out.where((F.col("minute") >= horizon // MINUTE) & (F.col("event_date") >= first))
        return out

    def rollups(self) -> DataFrame:
        """Rollups added up over batches, with the labels of the latest. A batch alone has one row for each key."""
        parts = self.partial_rollups()
        if len(self._attempts()) == 1:
            return parts.select(*ROLLUP_KEYS, "event_date", *ROLLUP_LABELS, *MEASURES)
        return rollups.merge_rollups(parts, order="batch")

    def sums(self, rng: TimeRange, step: int | None = None) -> DataFrame:
        """Rollup rows without labels that add up to those of a range: days, hours and, at its ends, minutes. `step`: the minutes of
        the buckets they will be added up by, if any. Batches written before there were tiers are read by minutes."""
        first, last = rng.minutes
        horizon = self.state()["horizon_ms"]
        first = first if horizon is None else max(first, horizon // MINUTE)
        columns = [*ROLLUP_KEYS, *MEASURES, "event_date"]
        tiered = set(self.files.names(self._folder("tiers")))
        old = {f"batch={self._named(b, n)}" for b, n in self._attempts().items()} - tiered
        by_tier: dict[int, list[tuple[int, int]]] = {}
        for tier, a, b in rollups.tier_spans(first, last, step):
            by_tier.setdefault(tier, []).append((a, b))
        parts = []
        for tier, spans in sorted(by_tier.items()):
            if tier == 1:
                rows = self._read("rollups", ROLLUP_SCHEMA, tiered)
            else:
                rows = self._read("tiers", TIER_SCHEMA, tiered).where(F.col("tier") == tier)
            parts.append(rollups.in_spans(rows, spans).select(*columns))
        if old or not parts:
            parts.append(rollups.in_spans(self._read("rollups", ROLLUP_SCHEMA, old), [(first, last)]).select(*columns))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def day_counts(self) -> dict[date | None, int]:
        """Events of each day as stored, from the commits; a horizon only hides whole days here, so its own day may count more than are left."""
        commits = self.commits()
        if commits.where("days is null").isEmpty():
            rows = commits.select(F.explode("days").alias("day", "n")).groupBy(F.to_date(F.nullif("day", F.lit(""))).alias("day")).agg(F.sum("n").alias("n"))
        else:
            rows = self.events().groupBy(F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        horizon = self.state()["horizon_ms"]
        if horizon is not None:
            rows = rows.where(F.col("day") >= F.date_from_unix_date(F.lit(horizon // DAY).cast("int")))
        return {r.day: r.n for r in rows.collect()}

    def page(self, f: ev.EventFilter) -> DataFrame:
        """A page of events, read from the days it lies in."""
        return paging.events_page(self.events(), f, self.day_counts(), self.state()["horizon_ms"])

    def export(self, f: ev.EventFilter, most: int = 50_000) -> DataFrame:
        """The newest events that fit, as exported, read from the days they are in."""
        return paging.export_events(self.events(), f, self.day_counts(), most, self.state()["horizon_ms"])

    # prices

    def prices(self) -> DataFrame:
        v = self.state()["prices"]
        return self.spark.read.schema(PRICE_SCHEMA).parquet(f"{self.root}/prices/v{v}") if v else self.spark.createDataFrame([], PRICE_SCHEMA)

    def _write_prices(self, prices: DataFrame, version: int, now_ms: int) -> None:
        pricing.check_prices(prices)
        stamp = F.when(F.coalesce("updated_at_ms", F.lit(0)) == 0, F.lit(now_ms)).otherwise(F.col("updated_at_ms"))
        clean = pricing.validate_prices(prices).drop("reason").withColumn("updated_at_ms", stamp.cast("long"))
        clean.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/prices/v{version}")

    def replace_prices(self, prices: DataFrame, now_ms: int | None = None) -> None:
        state = self.state()
        version = state["prices"] + 1
        self._write_prices(prices, version, int(time.time() * 1000) if now_ms is None else now_ms)
        self.files.advance("state", state | {"prices": version})

    # upkeep

    def prune(self, days: int, now_ms: int) -> None:
        if not 1 <= days <= 3650:
            raise ValueError("retention is 1 to 3650 days")
        horizon = now_ms - days * DAY
        state = self.state()
        self.files.advance("state", state | {"horizon_ms": max(horizon, state["horizon_ms"] or horizon)})
        limit = time.strftime("%Y-%m-%d", time.gmtime(horizon / 1000))
        for name in ("events", "rollups", "tiers"):
            for batch in self.files.names(self._folder(name)):
                for day in self.files.names(self._folder(f"{name}/{batch}")):
                    if day.startswith("event_date=") and day.removeprefix("event_date=") < limit:
                        self.files.delete(self._folder(f"{name}/{batch}/{day}"))

    def _swap(self, events: DataFrame, batch: str, normalized: bool, **state) -> None:
        old = self.state()
        g = old["generation"] + 1
        self.files.delete(f"gen-{g}")
        self.write_batch(events, batch, g, normalized)
        self.files.advance("state", old | {"generation": g} | state)

    def compact(self) -> None:
        """Rewrites all batches as one. Run it between batches, not beside a writer."""
        self._swap(self.events().drop("event_date"), "compacted", True)

    def restore(self, events: DataFrame, prices: DataFrame, version: int = 1, most: int = MOST_RESTORED, now_ms: int | None = None) -> dict:
        """Validates a backup, then replaces events, rollups and prices at once. events: event columns and `ordinal`."""
        if version != 1:
            raise ValueError(f"backups of version {version} are not known")
        found = ev.validate_backup(events).crossJoin(events.agg(F.count(F.lit(1)).alias("events"))).first()  # two single rows
        if found["events"] > most:
            raise ValueError(f"a backup may hold {most} events at most")
        if found["bad_ordinal"] is not None:
            raise ValueError(f"event {found['bad_ordinal']}: {found['reason']}")
        v = self.state()["prices"] + 1
        self._write_prices(prices, v, int(time.time() * 1000) if now_ms is None else now_ms)
        self._swap(events, "restored", False, prices=v, horizon_ms=None)
        return {"events": found["events"], "prices": self.prices().count()}

    def status(self) -> dict:
        """Events and rollups within the horizon, and the last write. Without a horizon commits tell the events; keys of several batches are counted once."""
        told = self.commits().agg(F.sum("events"), F.max("written_ms"), F.count_if(F.col("events").isNull())).first()
        events = self.events().count() if self.state()["horizon_ms"] is not None or told[2] else told[0] or 0
        return {"events": events, "rollups": self.rollups().count(), "last_write_ms": told[1]}

    # backup files

    def write_backup(self, path: str, most: int = 50_000) -> dict:
        """A folder of JSON lines with events and prices, and a manifest."""
        rows = ev.backup_events(self.events().drop("event_date"), most)
        flag = rows.select("truncated").first()
        rows.drop("truncated").withColumnRenamed("api_key_mask", "api_key").write.mode("overwrite").json(f"{path}/events")
        self.prices().write.mode("overwrite").json(f"{path}/prices")
        manifest = {"version": 1, "generated_at_ms": int(time.time() * 1000), "truncated": bool(flag and flag[0])}
        Files(self.spark, path).write("manifest.json", manifest)
        return manifest

    def read_backup(self, path: str) -> tuple[DataFrame, DataFrame, int]:
        """Events with ordinals, prices and version of a backup folder."""
        columns = T.StructType([T.StructField("api_key" if f.name == "api_key_mask" else f.name, f.dataType) for f in EVENT_SCHEMA.fields])
        rows = self.spark.read.schema(columns).json(f"{path}/events").withColumnRenamed("api_key", "api_key_mask")
        rows = rows.withColumn("ordinal", F.monotonically_increasing_id() + 1)
        return rows, self.spark.read.schema(PRICE_SCHEMA).json(f"{path}/prices"), Files(self.spark, path).read("manifest.json")["version"]

    def read_backup_document(self, path: str) -> tuple[DataFrame, DataFrame, int]:
        """The same of a single JSON document."""
        doc = self.spark.read.schema(BACKUP_SCHEMA).option("multiLine", True).json(path)
        rows = doc.select(F.posexplode("events").alias("ordinal", "e")).select((F.col("ordinal") + 1).alias("ordinal"), "e.*").withColumnRenamed("api_key", "api_key_mask")
        return rows, doc.select(F.explode("prices").alias("p")).select("p.*"), doc.select("version").first()[0]


def write_csv(rows: DataFrame, path: str) -> None:
    """An export, which has a bounded number of rows, as one CSV file in a folder: UTF-8 with a byte order mark, a header line, quotes doubled."""
    first, *others = rows.columns
    marked = rows.select(F.col(first).alias("\ufeff" + first), *others)
    options = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}
    marked.coalesce(1).write.mode("overwrite").options(**options).csv(path)
