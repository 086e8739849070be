"""Headers and footers learned from a corpus: lines near page ends that stand in many documents, and their removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.regex import lines_of, py_strip


@dataclass
class AdaptiveNoise:
    """Learns with fit, removes with remove. group is a column to learn within (a source, say); None learns over the whole corpus."""

    threshold: float = 0.3
    edge: int = 3
    longest: int = 100
    group: str | None = None
    noise: DataFrame | None = None

    def fit(self, docs: DataFrame, text: str = "text") -> AdaptiveNoise:
        """Document frequencies of structural lines: the first and last three of a document with more than six lines, else all.

        Every row is a document, null and empty ones too; a line counts once per document.
        """
        keys = [self.group] if self.group else []
        rows = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
        lines = F.filter(F.transform(lines_of(F.col("_text")), py_strip), lambda x: x != "")
        ends = rows.select(*keys, lines.alias("_lines")).select(*keys, F.when(F.size("_lines") > 2 * self.edge, F.concat(F.slice("_lines", 1, self.edge), F.slice("_lines", -self.edge, self.edge))).otherwise(F.col("_lines")).alias("_lines"))
        counted = ends.select(*keys, F.explode_outer(F.array_distinct("_lines")).alias("line")).filter(F.col("line").isNotNull()).groupBy(*keys, "line").agg(F.count("*").alias("df"))
        if keys:
            total = rows.groupBy(*keys).agg(F.count("*").alias("docs"))
            joined = counted.join(total, keys)
        else:
            joined = counted.crossJoin(F.broadcast(rows.agg(F.count("*").alias("docs"))))  # one row
        self.noise = joined.withColumn("frac", F.col("df") / F.col("docs")).filter(F.col("frac") >= self.threshold).select(*keys, "line", "df", "frac")
        return self

    def remove(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """docs with noise lines taken out of text; longer lines stay, others are kept unstripped. Null text stays null.

        By the threshold a document set has at most 6 / threshold noise lines, so they travel as one array: per group, joined; else
        broadcast as a single row.
        """
        if self.noise is None:
            raise RuntimeError("fit the noise before removing it")
        keys = [self.group] if self.group else []
        sets = self.noise.groupBy(*keys).agg(F.collect_set("line").alias("_noise"))
        joined = docs.join(sets, keys, "left") if keys else docs.crossJoin(F.broadcast(sets))
        gone = F.coalesce("_noise", F.array().cast("array<string>"))
        keep = F.filter(lines_of(F.col(text)), lambda x: ~F.array_contains(gone, py_strip(x)) | (F.length(py_strip(x)) > self.longest))
        return joined.withColumn(text, F.array_join(keep, "\n")).drop("_noise")
