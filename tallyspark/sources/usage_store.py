"""The test tables' usage records, stored once per session and input as the library stores events.

Queries run on stored tables, as they would in production: the first query on an input
decodes, normalises and writes the events and their rollups to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import stored_events
from .scratch import shared_dir
from .tables import UsageTables
from .usage_view import raw_usage

_stores: dict[tuple[str, str], UsageTables] = {}


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as decode_records gives them."""
    raw = raw_usage(spark, sf_dir)
    ns = {f"{n}_ns": F.col(f"{n}_ms") * 1_000_000 for n in ("latency", "ttft")}
    blank = {n: F.lit("") for n in ("executor_type", "alias", "reasoning_effort", "service_tier")}
    return raw.withColumns({**ns, **blank, "requested_at_ms": F.col("timestamp_ms"), "stream": F.lit(False)})


def usage_store(spark: SparkSession, sf_dir: str) -> UsageTables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        tables = UsageTables(spark, f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}")
        tables.write_batch(stored_events(usage_records(spark, sf_dir)), "first", normalized=True)
        _stores[key] = tables
    return _stores[key]
