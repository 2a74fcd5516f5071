"""Micro-batches of a stream, each reconciled with the current target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordia.options import Options
from concordia.plans.reconcile import reconcile


def reconcile_stream(stream: DataFrame, target: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Start a query that writes each micro-batch's discrepancies to ``output/batch=<id>``.

    *target* gives the rows that a batch is compared with.  A batch that is run again after a failure overwrites its
    own folder, so that its discrepancies are there once.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        found = reconcile(batch, target(batch), options).discrepancies
        found.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
