"""Incremental ingest: batches of a stream join an append-only claim log, and state is derived anew from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, log: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each batch is written under its own batch id; a replayed batch overwrites itself, so replay changes nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scope_state(runs: DataFrame) -> DataFrame:
    """Attempts, last run and last completion of each scope: the order of arrival does not matter."""
    done = F.when(F.col("status") == "purchase", F.col("started_at"))
    return runs.groupBy("source_id").agg(
        F.count("*").alias("attempts"), F.max("started_at").alias("last_run"), F.max(done).alias("completed_at"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"),
    )
