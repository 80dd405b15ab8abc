"""Reading of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than there are cores, dealt over all of them.

    What is done with records and texts takes much longer than reading them, and a small file is
    one split. Larger inputs have more splits than cores and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Records of a task that decodes them.
MOST_RECORDS = 100_000


def dealt(rows: DataFrame, unique: list[str], most: int = MOST_RECORDS) -> DataFrame:
    """Records dealt to tasks of about `most`, and to all cores if they are fewer.

    Splits of a file grow with it, and decoding what a split holds takes far longer than reading it.
    Rows of files are counted from their footers. `unique` are columns that tell rows apart.
    """
    n = -(-rows.count() // most)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *unique)
