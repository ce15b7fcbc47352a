"""Incremental ingest: a stream of cells, whose partial statistics are merged batch by batch.

The merge is algebraic, so late cells need no state beyond one row per key; a batch that is run again
overwrites its own partials and is not counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import statistics


def start(cells: DataFrame, root: str, keys: list[str], value: str = "v", nodata: float | None = None) -> StreamingQuery:
    """Write each batch's partials to root/partials/batch=N."""

    def batch(df: DataFrame, number: int) -> None:
        statistics.partials(df, keys, value, nodata).write.mode("overwrite").parquet(f"{root}/partials/batch={number}")

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The statistics of all batches so far."""
    return statistics.variance(statistics.merged(spark.read.parquet(f"{root}/partials").drop("batch"), keys))
