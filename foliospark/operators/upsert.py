"""Writing by key: one row of several with the same key, and new rows in the place of old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with one row for each key: the least by the columns of order, nulls first, whatever the order they come in.

    Aggregated before it is shuffled, so many rows of one key cost one row per task.
    """
    first, rest = F.struct(*order), F.struct(*[c for c in rows.columns if c != key])
    picked = rows.groupBy(key).agg(F.min_by(rest, first).alias("_r"))
    return picked.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new, and those of old whose key new has not; keys of either are taken as they are, null keys never match."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
