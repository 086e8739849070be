"""Ingestion jobs: an append-only table of states, and the last state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """job_id, filename, status, error, updated_at: the row of each job with the latest time.

    Of rows with one time the one that sorts last counts; repeated rows count once; null times come before all others.
    """
    best = F.max(F.struct("updated_at", "status", "error", "filename")).alias("b")
    return jobs.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(best).select("job_id", "b.filename", "b.status", "b.error", "b.updated_at")


def status(jobs: DataFrame, job_id: str) -> dict:
    """The status of one job for an API; an unknown one is an error entry."""
    row = latest(jobs.filter(F.col("job_id") == job_id)).first()
    if row is None:
        return {"error": "job not found"}
    out = {"status": row["status"], "filename": row["filename"]}
    return out | ({"error": row["error"]} if row["error"] is not None else {})
