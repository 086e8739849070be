"""Loading of the named Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table as stored; columns and filters of later steps reach its scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is stored in so few pieces that most cores would idle: a small file can't be split for long work on it.

    What is stored in enough pieces, as large tables are, comes back as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
