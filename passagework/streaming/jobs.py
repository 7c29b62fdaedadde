"""Ingestion as a stream: new rows of a landing folder are claimed by Spark's offset log, processed batch by batch, and written
so that a batch that is run again after a failure replaces what it wrote before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.session import shared_checkpoints


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors see."""
    return f"{shared_checkpoints(spark)}/stream-{uuid.uuid4().hex}"


def run_batches(source: DataFrame, out: str, process: Callable[[DataFrame], DataFrame], mode: str = "append") -> None:
    """Runs all input that is there through ``process`` in micro-batches. Each writes a folder of its own, named by the
    batch, so a batch that is repeated after a crash overwrites its earlier attempt: every row counts once."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = source.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows")


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 4) -> DataFrame:
    """Rows of the files of a table as they arrive. The path is given as a pattern, since a table may be one file, and
    a plain path of a stream must be a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str | None = None, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Numbers and sums per time window and kind. Every row counts, however late: windows stay open, a row of state per
    window and kind. With ``late`` the state is bounded, and rows later than that are left out."""
    timely = events.withWatermark(ts, late) if late else events
    return (
        timely.groupBy(F.window(ts, length).alias("w"), F.col(kind).alias("kind"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), "kind", "n", "total")
    )


def last_state(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest update of every key (updates carry the batch that wrote them)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return updates.withColumn("__n", n).where("__n = 1").drop("__n", "batch")


def job_states(jobs: DataFrame) -> DataFrame:
    """One row per job with its terminal state: ``cancelled`` if it was asked to stop, ``partial`` if some but not all
    documents were done, else as it says."""
    done = F.coalesce("processed_documents", F.lit(0))
    state = F.when(F.col("cancel_requested"), "cancelled").when((done > 0) & (done < F.col("total_documents")), "partial").otherwise(F.col("status"))
    return jobs.dropDuplicates(["id"]).select(F.col("id").alias("job_id"), "resource_id", state.alias("state"), "created_at")
