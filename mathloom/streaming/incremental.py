"""Rows that arrive over time, worked off exactly once per key.

Each micro-batch drops the keys that the output already has, so a restarted stream, or a batch
that is run again after a failure, writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mathloom.operators import keyed
from mathloom.scratch import exists


def work_off(arriving: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], output: str, progress: str, order: list[str] | None = None) -> StreamingQuery:
    """Start a query that appends ``work`` of the new keys to the Parquet folder ``output``.

    ``work`` must keep the keys.  ``progress`` is the stream's checkpoint folder; both folders must
    be reachable by all executors, on any file system.  Of rows of one key within a batch the
    smallest by ``order`` (all other columns unless given) is worked; later batches leave it out.
    """
    by = order or [c for c in arriving.columns if c not in keys] or keys

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = keyed.first_by(df, keys, F.struct(*by))
        if exists(spark, output):
            fresh = keyed.pending(fresh, spark.read.parquet(output), keys)
        work(fresh).write.mode("append").parquet(output)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
