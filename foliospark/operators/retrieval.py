"""Retrieval: lexical and vector legs, score normalisation, weighted fusion, reranking, roll-up by document.

Scores are cut and ordered by their value to nine places and then by id, so that equal scores have one order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions.regex import terms_of
from foliospark.operators.predicates import metadata_filter, require_text
from foliospark.session import materialise

PLACES = 9


def query_terms(query: str) -> list[str]:
    """The words of a query in lower case, repeated ones repeated."""
    import re

    return re.findall(r"\w+", require_text(query, "query").lower())


# -- lexical -----------------------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """term, id, tf: how often each word stands in each text; one row per word and text is the only shuffle."""
    return docs.select(F.col(key).alias("id"), F.explode_outer(terms_of(F.col(text))).alias("term")).filter(F.col("term").isNotNull()).groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """id, dl: the number of words of each text; null has none."""
    return docs.select(F.col(key).alias("id"), F.coalesce(F.size(terms_of(F.coalesce(text, F.lit("")))), F.lit(0)).cast("bigint").alias("dl"))


def bm25(docs: DataFrame, query: str, key: str = "id", text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of every text with a word of the query: the sum over query words, repeated ones added, of idf * tf / (tf + norm).

    Works from texts without an index in one pass over them: each text is reduced to its length and the counts of the query's words,
    which are written once; statistics and scores come from there. Ids must be unique. Texts without words count in the corpus size and the
    mean length.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    words = terms_of(F.coalesce(F.col(text), F.lit("")))
    counts = docs.select(F.col(key).alias("id"), words.alias("_w")).select("id", F.size("_w").alias("dl"), *[_count(F.col("_w"), t).alias(f"tf{i}") for i, t in enumerate(distinct)])
    base = materialise(counts, "counts")
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(distinct))]).first()
    n, avgdl = stats["n"] or 0, stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        df = stats[f"df{i}"] or 0
        idf = float(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        score = score + F.lit(terms.count(t) * idf) * tf / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    hit = [F.col(f"tf{i}") > 0 for i in range(len(distinct))]
    return base.filter(F.lit(False) if not hit else _any(hit)).select("id", score.alias("score"))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def bm25_indexed(posted: DataFrame, lens: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same from postings and lengths: only the query's words are read, which pruning by term keeps small."""
    terms = query_terms(query)
    distinct = sorted(set(terms))
    matched = posted.filter(F.col("term").isin(distinct))
    stats = lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    dfs = {r["term"]: r["df"] for r in matched.groupBy("term").agg(F.count("*").alias("df")).collect()}  # as many rows as query words
    n, avgdl = stats["n"] or 0, stats["avgdl"] or 1.0
    weight = {t: terms.count(t) * float(np.log(1 + (n - df + 0.5) / (df + 0.5))) for t, df in dfs.items()}
    if not weight:
        return matched.select("id", F.lit(0.0).alias("score")).limit(0)
    idf = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term"))
    tf = F.col("tf").cast("double")
    part = idf * tf / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    return matched.join(lens, "id").select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))


# -- vectors -----------------------------------------------------------------------------------------------------------------------


def usable_vector(vector: Column, dim: int) -> Column:
    """Not null, of the right length, finite throughout and not zero throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def squared_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def knn(docs: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """id, score = 1 / (1 + squared distance) of the k nearest rows, exactly. Unusable vectors take no part."""
    rows = docs.select(F.col(key).alias("id"), F.col(vector).alias("_v")).filter(usable_vector(F.col("_v"), len(query)))
    return top_k(rows.select("id", (1 / (1 + squared_distance(F.col("_v"), query))).alias("score")), k)


def knn_many(docs: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", dim: int = 64, block: int = 4096, metric: str = "l2") -> DataFrame:
    """query, key, score of the k nearest rows of each query (a row is not its own neighbour), exactly, by block products.

    Queries go to the executors in blocks of a fixed number; each task multiplies its rows with the block and keeps k for each query, so
    what is shuffled is k rows per query and task. The number of passes grows with the queries, not what is sent at once.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    out_type = f"query {kind}, {key} {kind}, score double"
    rows = docs.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter(usable_vector(F.col("_v"), dim))
    asked = queries.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter(usable_vector(F.col("_v"), dim))
    numbered = asked.withColumn("_n", F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-queries.count() // block)))))
    parts = None
    for n in [r["_n"] for r in numbered.select("_n").distinct().collect()]:  # the numbers of blocks
        got = numbered.filter(F.col("_n") == n).toArrow()  # about block rows
        sent = spark.sparkContext.broadcast((got.column("_id").to_pylist(), _matrix(got.column("_v"), dim)))

        def tile(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list[list[tuple]] = [[] for _ in names]
            qq = (q * q).sum(axis=1)
            schema = None
            for b in batches:
                schema = b.schema
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    x, ids = _matrix(part.column("_v"), dim), part.column("_id").to_pylist()
                    if metric == "l2":
                        d = np.maximum(qq[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0)
                        score = 1 / (1 + d)
                    else:
                        score = (q @ x.T) / np.sqrt(qq)[:, None] / np.sqrt((x * x).sum(axis=1))[None, :]
                    take = min(k + 1, len(ids))
                    cut = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take] if take < len(ids) else np.full(len(q), -np.inf)
                    for i, name in enumerate(names):
                        near = [(-round(float(score[i, j]), PLACES), ids[j], float(score[i, j])) for j in np.flatnonzero(score[i] >= cut[i] - 1e-9) if ids[j] != name]
                        best[i] = sorted(best[i] + near)[:k]
            if schema is not None:
                flat = [(names[i], n, s) for i in range(len(names)) for _, n, s in best[i]]
                t = schema.field("_id").type
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], t), pa.array([f[1] for f in flat], t), pa.array([f[2] for f in flat], pa.float64())], ["query", key, "score"])

        near = rows.mapInArrow(tile, out_type)
        parts = near if parts is None else parts.unionByName(near)
    if parts is None:
        return spark.createDataFrame([], out_type)
    order = W.partitionBy("query").orderBy(F.round("score", PLACES).desc(), F.col(key))
    return parts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


# -- fusion ------------------------------------------------------------------------------------------------------------------------


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows, ties by id: a partial top-k in each task, then one merge."""
    return scored.orderBy(F.round(score, PLACES).desc(), "id").limit(k)


def min_max(scored: DataFrame, leg: str = "leg", floor: float = 0.001) -> DataFrame:
    """scored with the column norm: scores of each leg scaled to its retrieved candidates; all equal gives 1, the least gives the floor."""
    w = W.partitionBy(leg)
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.try_divide(F.col("score") - low, high - low)
    return scored.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise(F.when(scaled <= 0, F.lit(floor)).otherwise(scaled)))


def fuse(legs: dict[str, tuple[DataFrame, float]], floor: float = 0.001) -> DataFrame:
    """id, score: the weighted mean of the normalised scores; a leg that lacks a row adds nothing but keeps its weight."""
    union, total = None, float(sum(w for _, w in legs.values()))
    for name, (df, weight) in legs.items():
        one = df.select("id", "score", F.lit(name).alias("leg"), F.lit(float(weight)).alias("weight"))
        union = one if union is None else union.unionByName(one)
    return min_max(union, floor=floor).groupBy("id").agg((F.sum(F.col("norm") * F.col("weight")) / total).alias("score"))


def hybrid(docs: DataFrame, query: str, vector: list[float], k: int, filters: dict | None = None, config: Config = Config(), lexical: DataFrame | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """id, score of the k best of both legs. Filters apply before the legs; lexical and nearest replace the legs from texts and vectors by
    ones from an index."""
    kept = docs.filter(metadata_filter(filters)) if filters else docs
    leg = bm25(kept, query, k1=config.k1, b=config.b) if lexical is None else lexical
    return top_k(fuse({"lexical": (top_k(leg, k), config.lexical_weight), "vector": (knn(kept, vector, k) if nearest is None else top_k(nearest, k), config.vector_weight)}, config.normal_floor), k)


def project_hits(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """Hits with content and what metadata a reader may see: no vector, file hash or chunk number; missing fields have defaults."""
    hits = docs.join(F.broadcast(scored), "id")  # at most k rows
    meta = F.col("metadata").dropFields("file_hash", "chunk_id")
    return hits.select("id", F.coalesce("document_id", F.lit("")).alias("document_id"), F.coalesce("content", F.lit("")).alias("content"), meta.alias("metadata"), "score")


# -- reranking and roll-up ---------------------------------------------------------------------------------------------------------


def overlap_score(query: str) -> Callable[[Column], Column]:
    """A stand-in for a cross-encoder: the share of the query's distinct words that the text has."""
    terms = sorted(set(query_terms(query)))

    def score(text: Column) -> Column:
        have = F.size(F.array_intersect(terms_of(F.coalesce(text, F.lit(""))), F.array(*[F.lit(t) for t in terms])))
        return have / F.lit(float(len(terms))) if terms else F.lit(0.0)

    return score


@cache
def _reranker(model_name: str):
    """Loaded once by each Python worker, which serves many tasks."""
    from sentence_transformers import CrossEncoder

    return CrossEncoder(model_name)


def cross_encoder(model_name: str) -> Callable[[str], Callable[[Column], Column]]:
    """A sentence-transformers cross-encoder as a scorer, where the library and the model are installed."""

    def for_query(query: str) -> Callable[[Column], Column]:
        @F.pandas_udf("double")
        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            model = _reranker(model_name)
            for s in batches:
                yield pd.Series(model.predict([(query, t or "") for t in s]))

        return run

    return for_query


def rerank(hits: DataFrame, query: str, scorer: Callable[[str], Callable[[Column], Column]] = overlap_score, text: str = "content") -> DataFrame:
    """hits with rerank_score and rank (from 1): by rerank_score, then score, then retrieval order. A blank query keeps the order.

    There are as many hits as were asked for, so the one window over all of them is small.
    """
    retrieval = [F.round("score", PLACES).desc(), F.col("id")]
    if not query or not query.strip():
        return hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(W.orderBy(*retrieval)))
    scored = hits.withColumn("rerank_score", scorer(query)(F.col(text)))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.round("rerank_score", PLACES).desc(), *retrieval)))


def roll_up(ranked: DataFrame, per_document: int = 3, name: str = "metadata.filename", max_docs: int | None = None) -> DataFrame:
    """document_id, document_name, chunks, semantic_score, rerank_score, first_rank: the best hits of each document summed up.

    At most per_document hits of a document count; documents come in the order of their best hit, all of them unless max_docs is given.
    """
    w = W.partitionBy("document_id").orderBy("rank")
    best = ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_document)
    rolled = best.groupBy("document_id").agg(F.min_by(F.col(name), "rank").alias("document_name"), F.count("*").alias("chunks"), F.sum("score").alias("semantic_score"), F.sum("rerank_score").alias("rerank_score"), F.min("rank").alias("first_rank"))
    ordered = rolled.orderBy("first_rank")
    return ordered if max_docs is None else ordered.limit(max_docs)


def as_response(rolled: DataFrame) -> dict:
    """The roll-up as the mapping that an API would send; as many entries as documents were found."""
    return {r["document_id"]: {"document_name": r["document_name"], "chunks": r["chunks"], "semantic_score": r["semantic_score"], "rerank_score": r["rerank_score"]} for r in rolled.orderBy("first_rank").collect()}


