"""Streaming queries: input is streamed to its end, and the result is what the batch equivalent gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.queries import query
from passagework.session import read_table
from passagework.streaming import jobs


@query("stream_job_states", """SELECT id AS job_id, any_value(CASE WHEN cancel_requested THEN 'cancelled' WHEN coalesce(processed_documents, 0) > 0 AND coalesce(processed_documents, 0) < total_documents THEN 'partial' ELSE status END) AS state FROM ingestion_jobs GROUP BY ALL""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs claimed batch by batch; a job that arrives twice counts once."""
    out = jobs.shared_folder(spark)
    source = jobs.read_stream(spark, f"{sf_dir}/ingestion_jobs.parquet", read_table(spark, sf_dir, "ingestion_jobs").schema)
    jobs.run_batches(source, out, jobs.job_states)
    return jobs.last_state(jobs.results(spark, out), "job_id").select("job_id", "state")


@query("stream_activity", "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, kept up to date while the stream runs."""
    out = jobs.shared_folder(spark)
    events = read_table(spark, sf_dir, "events")
    source = jobs.read_stream(spark, f"{sf_dir}/events.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.run_batches(jobs.windowed_counts(source), out, lambda b: b, mode="update")
    rows = jobs.last_state(jobs.results(spark, out), "window_start", "kind")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n", F.round("total", 4).alias("total"))
