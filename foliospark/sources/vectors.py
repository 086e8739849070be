"""An approximate vector index: rows in cells around centres, stored in the order of the cells.

A search reads the row groups of the cells nearest to the query and nothing else, as the cells reach the scan as a filter; inside them
distances are exact. The centres come from k-means on a bounded sample; every usable row is indexed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.retrieval import knn, usable_vector

#: Rows of the k-means sample at most, and sample rows for each centre at least: so there are SAMPLE / PER_CENTRE cells at most.
SAMPLE, PER_CENTRE = 65_536, 16
#: The share of the cells that a search reads by default, and the least number of them.
PROBE_SHARE, LEAST_PROBES = 0.05, 8


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), dim)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the centre at the least Euclidean distance."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Means of the sample's rows by nearest centre; an empty cell keeps its first centre."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(sample, centres)
        order = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        counts = np.diff(np.append(begins, len(own)))
        centres[own[order][begins]] = np.add.reduceat(sample[order], begins, axis=0) / counts[:, None]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """An index at a path that all executors reach; dim is the length of its vectors."""

    spark: SparkSession
    path: str
    dim: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", vector: str = "embedding", dim: int = 768, cells: int | None = None) -> VectorIndex:
        """Writes the index of rows; those with null, short, long, zero or non-finite vectors are left out, null keys stay.

        The number of cells is the square root of the rows unless it is given. An empty table makes an empty index.
        """
        spark = rows.sparkSession
        used = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("embedding")).filter(usable_vector(F.col("embedding"), dim))
        wanted = max(1, min(cells or round(used.count() ** 0.5), SAMPLE // PER_CENTRE))
        drawn = used.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
        sample = _rows(drawn.column("embedding"), dim)
        centres = kmeans(sample, wanted) if len(sample) else np.zeros((1, dim), np.float32)
        sent = spark.sparkContext.broadcast(centres)  # at most SAMPLE / PER_CENTRE rows

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = nearest_centre(_rows(b.column("embedding"), dim), sent.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(cell.astype(np.int32))], ["id", "embedding", "cell"])

        placed = used.mapInArrow(assign, f"id {used.schema['id'].dataType.simpleString()}, embedding array<float>, cell int")
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")
        described = [(i, json.dumps([float(v) for v in c])) for i, c in enumerate(centres)]
        spark.createDataFrame(described, "cell int, centre string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path, dim)

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # bounded, see build
        return np.array([json.loads(r["centre"]) for r in rows], np.float32)

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """id, score of the k rows nearest to the query among those of its probes nearest cells, scored as knn scores them."""
        centres = self.centres()
        many = probes or max(LEAST_PROBES, round(PROBE_SHARE * len(centres)))
        distance = ((centres - np.asarray(query, np.float32)) ** 2).sum(axis=1)
        chosen = [int(c) for c in np.argsort(distance, kind="stable")[:many]]
        return knn(self.spark.read.parquet(f"{self.path}/cells").filter(F.col("cell").isin(chosen)), query, k)
