"""The search service: embed the query, retrieve by both legs, rerank, roll up by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from foliospark.config import Config
from foliospark.operators import retrieval as R
from foliospark.operators.embedding import Embedder, HashingEmbedder, embed_single
from foliospark.sources.index import Index
from foliospark.sources.vectors import VectorIndex


def search_table(docs: DataFrame, query: str, vector: list[float], limit: int = 5, filters: dict | None = None, config: Config = Config(), scorer: Callable[[str], Callable[[Column], Column]] = R.overlap_score, lexical: DataFrame | None = None, nearest: DataFrame | None = None, max_docs: int | None = None) -> DataFrame:
    """The roll-up for a query over rows of the index; limit sets the candidates (limit * overfetch), not the documents."""
    scored = R.hybrid(docs, query, vector, limit * config.overfetch, filters, config, lexical, nearest)
    return R.roll_up(R.rerank(R.project_hits(docs, scored), query, scorer), config.chunks_per_document, max_docs=max_docs)


def search(index: Index, query: str, limit: int = 5, filters: dict | None = None, embedder: Embedder | None = None, config: Config = Config(), is_query: bool = False, vectors: VectorIndex | None = None, **options: object) -> DataFrame:
    """Search an index. Its postings serve the lexical leg; the query gets the passage prefix unless is_query is set.

    vectors serves the vector leg of a search without filters from an approximate index instead of all rows.
    """
    embedder = embedder or HashingEmbedder(index.manifest()["dimension"])
    vector = embed_single(query, embedder, is_query, config.query_prefix, config.passage_prefix)
    docs = index.chunks()
    posted, lens = index.postings(), index.lengths()
    if filters:
        kept = docs.filter(R.metadata_filter(filters)).select("id")
        posted, lens = posted.join(kept, "id", "left_semi"), lens.join(kept, "id", "left_semi")
    lexical = R.bm25_indexed(posted, lens, query, config.k1, config.b)
    nearest = vectors.search(vector, limit * config.overfetch) if vectors is not None and not filters else None
    return search_table(docs, query, vector, limit, filters, config, lexical=lexical, nearest=nearest, **options)  # type: ignore[arg-type]


class SearchError(RuntimeError):
    """A search that failed, at planning or on an executor."""


def run_search(index: Index, query: str, limit: int = 5, **options: object) -> dict:
    """The response of a search, which is run here: so failures on executors, too, come as SearchError. A blank query is a ValueError."""
    try:
        return R.as_response(search(index, query, limit, **options))  # type: ignore[arg-type]
    except ValueError:
        raise
    except Exception as e:
        raise SearchError(f"search failed: {e}") from e


def knn_recall(found: DataFrame, truth: DataFrame, query: str = "query", key: str = "id") -> float:
    """The share of true (query, key) pairs that were found."""
    total = truth.count()
    return truth.join(found.select(query, key).distinct(), [query, key], "left_semi").count() / total if total else 1.0
