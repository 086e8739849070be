"""The engine's functions for SQL: every cleaning step, the whole chain, and a table function for chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import bulk
from foliospark.operators.chunking import Windows, pack, whitespace_tokens

#: SQL bodies of functions that are single patterns: built-in expressions, so the optimiser sees through them.
_SQL = {
    "private_use_to_space": r"regexp_replace(t, '[\\x{E000}-\\x{F8FF}]', ' ')",
    "fix_hyphenation": r"regexp_replace(t, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)', '$1$2')",
    "normalize_linebreaks": r"regexp_replace(regexp_replace(t, '(?<!\\n)\\n(?!\\n)', ' '), '\\n{3,}', '\n\n')",
    "remove_urdu_marks": r"regexp_replace(t, '[\\^~|&]', '')",
}


def _step(name: str):
    """A cleaning step as an Arrow function."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = bulk.single()[name]
        for s in batches:
            yield pd.Series([None if t is None else reduce(lambda x, f: f(x), parts, t) for t in s], dtype=object)

    return run


def register(spark: SparkSession, prefix: str = "folio_") -> list[str]:
    """Registers the functions; gives their names."""
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS STRING RETURN {body}")

    @F.udtf(returnType="chunk_no int, content string")
    class Chunks:
        """Chunks of a text's sentences (an array) by a limit, an overlap and a least size in white-space tokens."""

        def eval(self, sentences: list, limit: int, overlap: int, minimum: int) -> Iterator[tuple]:
            w = Windows(limit, overlap, minimum)
            kept = [c for c in pack([whitespace_tokens(s) for s in sentences or []], w) if len(c) + w.special >= minimum]
            for i, c in enumerate(kept):
                yield i, " ".join(c)

    for name in set(bulk.single()) - set(_SQL):
        spark.udf.register(f"{prefix}{name}", _step(name))
    spark.udtf.register(f"{prefix}chunks", Chunks)
    spark.udf.register(f"{prefix}clean_page", F.udf(bulk.clean, T.StringType(), useArrow=True))
    return [f"{prefix}{n}" for n in (*sorted(bulk.single()), "chunks", "clean_page")]
