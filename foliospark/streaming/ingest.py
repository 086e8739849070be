"""Continuous ingestion: files that land in a folder are indexed batch by batch, and their jobs recorded.

The stream's checkpoint and the index, which rejects what it knows, make a replayed batch harmless: rows of a job's state carry an id
made of the file's name and hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliospark.config import Config
from foliospark.operators import jobs as J
from foliospark.operators.embedding import Embedder
from foliospark.plans.ingest import ingest_files
from foliospark.schema import JOBS
from foliospark.sources.index import Index
from foliospark.sources.pages import Ocr, no_ocr, with_hash

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def job_key(filename: str, file_hash: str) -> str:
    """The id of the job of a file, as job_id makes it."""
    return hashlib.sha256(f"{filename}/{file_hash}".encode()).hexdigest()[:32]


def job_id(filename: str = "filename", file_hash: str = "file_hash"):
    return F.substring(F.sha2(F.concat_ws("/", filename, file_hash), 256), 1, 32)


def record(files: DataFrame, status: str, path: str) -> None:
    """Appends a state for each file; files may have their own status and error."""
    has = "status" in files.columns
    rows = files.select(job_id().alias("job_id"), "filename", F.col("status") if has else F.lit(status).alias("status"), F.col("error") if has else F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("updated_at"))
    rows.write.mode("append").parquet(path)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOBS).parquet(path)


def job_status(spark: SparkSession, path: str, job: str) -> dict:
    return J.status(jobs(spark, path), job)


def ingest_stream(spark: SparkSession, index: Index, landing: str, jobs_path: str, checkpoint: str, embedder: Embedder | None = None, config: Config = Config(), ocr: Ocr = no_ocr, files_per_batch: int = 100, queued: bool = True) -> StreamingQuery:
    """Starts the stream over what is there now and ends when that is done; start it again for what has landed since.

    queued is whether the stream records files as queued itself; a submitting front end has done so already.
    """

    def batch(df: DataFrame, _: int) -> None:
        files = with_hash(df)
        names = files.select("filename", "file_hash")
        if queued:
            record(names, "queued", jobs_path)
        record(names, "processing", jobs_path)
        _, outcome = ingest_files(spark, index, files, embedder, config, ocr)
        record(outcome, "", jobs_path)

    source = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(landing)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
