"""The engine as one object: submit files, run what has landed, ask for the state of a job, search."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import jobs as J
from foliospark.operators.embedding import Embedder, HashingEmbedder
from foliospark.plans import search as S
from foliospark.schema import JOBS
from foliospark.sources.index import Index
from foliospark.sources.pages import Ocr, no_ocr
from foliospark.streaming import ingest as I  # noqa: E741


class Engine:
    """An index, a landing folder, a job table and a checkpoint under one root, which may be on a shared store."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: Config = Config(), ocr: Ocr = no_ocr):
        self.spark, self.root, self.config, self.ocr = spark, root.rstrip("/"), config, ocr
        self.embedder = embedder or HashingEmbedder(config.dimension)
        self.index = Index.create(spark, f"{self.root}/{config.index_path}", self.embedder.dimension)

    def submit(self, path: str) -> str:
        """Puts a local file into the landing folder and records it as queued; gives the job's id at once. A missing file is an error.

        The landed name starts with the job's id, so files of one name don't overwrite each other; the index sees the plain name.
        """
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        name = os.path.basename(path)
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 16):
                digest.update(block)
        job = I.job_key(name, digest.hexdigest())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.root}/landing/{job}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.copyFromLocalFile(False, True, hadoop.Path(f"file://{os.path.abspath(path)}"), hadoop.Path(folder, name))
        I.record(self.spark.createDataFrame([(name, digest.hexdigest())], "filename string, file_hash string"), "queued", f"{self.root}/jobs")
        return job

    def run(self) -> None:
        """Indexes what has landed since the last run; files whose jobs have ended are removed from the landing folder."""
        query = I.ingest_stream(self.spark, self.index, f"{self.root}/landing/*", f"{self.root}/jobs", f"{self.root}/checkpoint", self.embedder, self.config, self.ocr, queued=False)
        query.awaitTermination()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        landing = hadoop.Path(f"{self.root}/landing")
        fs = landing.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(landing):
            return
        waiting = {f.getPath().getName() for f in fs.listStatus(landing)}
        for r in self.jobs().filter(F.col("job_id").isin(*waiting) & F.col("status").isin("success", "failed")).select("job_id").collect() if waiting else ():
            fs.delete(hadoop.Path(landing, r["job_id"]), True)

    def jobs(self) -> DataFrame:
        """The last state of every job."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(f"{self.root}/jobs")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return J.latest(I.jobs(self.spark, f"{self.root}/jobs") if there else self.spark.createDataFrame([], JOBS))

    def job_status(self, job: str) -> dict:
        row = self.jobs().filter(F.col("job_id") == job).first()
        if row is None:
            return {"error": "job not found"}
        return {k: row[k] for k in ("status", "filename", "error") if k != "error" or row[k] is not None}

    def search(self, query: str, limit: int = 5, filters: dict | None = None) -> dict:
        """The response of the search: by document its name, chunks, semantic and rerank score, best first."""
        return {"Succeeded": True, "response": S.run_search(self.index, query, limit, filters=filters, embedder=self.embedder, config=self.config)}
