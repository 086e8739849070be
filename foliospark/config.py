"""Settings of the engine, from defaults, the environment (FOLIOSPARK_...) or Spark's configuration (spark.foliospark....)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """The window, overlap and least size of chunks in tokens; the embedding; fusion; search."""

    index_path: str = "index"
    dimension: int = 768
    safe_limit: int = 504
    overlap: int = 50
    minimum: int = 75
    special_tokens: int = 2
    embed_batch: int = 32
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    lexical_weight: float = 0.3
    vector_weight: float = 0.7
    normal_floor: float = 0.001
    k1: float = 1.2
    b: float = 0.75
    overfetch: int = 10
    chunks_per_document: int = 3

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Config:
        kinds = {"int": int, "float": float, "str": str}
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"FOLIOSPARK_{f.name.upper()}")
            if spark is not None:
                value = spark.conf.get(f"spark.foliospark.{f.name}", value)
            if value is not None:
                found[f.name] = kinds[f.type](value)
        return cls(**found)
