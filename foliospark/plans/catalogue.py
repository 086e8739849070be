"""Named queries over the tables of a folder: one or more for each operator, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions import bulk, cleaning
from foliospark.functions.regex import is_blank, terms_of, tokens_of
from foliospark.operators import chunking, embedding, jobs, noise, predicates, retrieval, tokenizers, upsert
from foliospark.plans import ingest, search
from foliospark.session import shared_dir
from foliospark.sources.index import Index
from foliospark.sources.vectors import VectorIndex
from foliospark.tables import load, spread

Query = Callable[[SparkSession, str], DataFrame]

#: The query text, the candidates and the window sizes of the sample queries.
QUERY_TEXT, CANDIDATES, LIMIT = "flood barrier drawings of the safety committee", 50, 5
SMALL = chunking.Windows(limit=64, overlap=8, minimum=12)
NOISE_THRESHOLD = 0.005
KNOWN_BELOW = "8"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of pages that long text work needs, over all cores."""
    return spread(_pages(spark, folder).select("page_id", "file_hash", "filename", "page_number", "text", "source_type"))


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """id and content of the distinct chunks."""
    return load(spark, folder, "chunks").select("id", "content").distinct()


def _text_query(step: Callable) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _texts(spark, folder).select("page_id", step(F.col("text")).alias("text"))

    return run


TEXT_STEPS: dict[str, Callable] = {
    "t_private_use": cleaning.private_use_to_space,
    "t_strip_structural": cleaning.strip_structural_noise,
    "t_headers_footers": cleaning.remove_headers_footers,
    "t_hyphenation": cleaning.fix_hyphenation,
    "t_linebreaks": cleaning.normalize_linebreaks,
    "t_whitespace": cleaning.normalize_whitespace,
    "t_dedup_paragraphs": cleaning.deduplicate_paragraphs,
    "t_artifacts": cleaning.clean_formatting_artifacts,
    "t_short_lines": cleaning.remove_short_lines,
    "t_numeric_spacing": cleaning.fix_numeric_spacing,
    "t_letter_spacing": cleaning.fix_letter_spacing,
    "t_ocr_confusions": cleaning.fix_common_ocr_confusions,
    "t_garbage_lines": cleaning.remove_garbage_lines,
    "clean_digital": lambda t: cleaning.chain(t, cleaning.DIGITAL),
    "clean_ocr": lambda t: cleaning.chain(t, cleaning.OCR),
    "clean_urdu": lambda t: cleaning.chain(t, cleaning.URDU),
}
#: Without SQL: NFKC and the repair of encodings have no counterpart there.
NFKC_STEPS: dict[str, Callable] = {"t_nfkc": cleaning.nfkc, "t_mojibake": cleaning.fix_mojibake, "t_encoding": cleaning.clean_encoding}


def clean_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """The chain of each page's source type, without the encoding step."""
    return _texts(spark, folder).select("page_id", cleaning.preprocess_page(F.col("text"), F.col("source_type"), encode=lambda t: t).alias("text"))


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The full chain by built-in expressions and NFKC."""
    return _texts(spark, folder).select("page_id", cleaning.preprocess_page(F.col("text"), F.col("source_type")).alias("text"))


def clean_pages_bulk(spark: SparkSession, folder: str) -> DataFrame:
    """The full chain in one Arrow function."""
    return _texts(spark, folder).select("page_id", bulk.preprocess_page_bulk(F.col("text"), F.col("source_type")).alias("text"))


def noise_fit(spark: SparkSession, folder: str) -> DataFrame:
    learned = noise.AdaptiveNoise(threshold=NOISE_THRESHOLD).fit(_texts(spark, folder)).noise
    return learned.select("line", "df", F.round("frac", 9).alias("frac"))


def noise_remove(spark: SparkSession, folder: str) -> DataFrame:
    pages = _texts(spark, folder).select("page_id", "text")
    return noise.AdaptiveNoise(threshold=NOISE_THRESHOLD).fit(pages).remove(pages, "page_id")


def route_scanned(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, scanned; every second page counts as one with an image."""
    return _pages(spark, folder).select("page_id", predicates.is_scanned(F.col("text"), F.col("page_id") % 2 == 0).alias("scanned"), predicates.text_length(F.col("text")).cast("bigint").alias("chars"))


def english_ocr_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Against the words of the evaluation texts as a dictionary."""
    words = load(spark, folder, "eval_items").select(F.explode(predicates.english_words(F.col("text"))).alias("word"))
    return predicates.with_valid_english(_texts(spark, folder).select("page_id", "text"), words)


def blank_filter(spark: SparkSession, folder: str) -> DataFrame:
    return predicates.drop_blank(_pages(spark, folder)).select("page_id")


def file_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = load(spark, folder, "file_meta").select("file_hash", "filename").distinct()
    return files, files.filter(F.col("file_hash") < KNOWN_BELOW)


def dedup_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Files that an index of some of them would take: neither hash nor name known."""
    files, known = _files(spark, folder)
    return predicates.new_files(files, known).select("file_hash", "filename")


def existing_semi(spark: SparkSession, folder: str) -> DataFrame:
    files, known = _files(spark, folder)
    return predicates.known_files(files, known, "filename").select("file_hash", "filename")


def metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "vector_index").filter(predicates.metadata_filter({"page_number": 1, "chunk_id": 1})).select("id")


def language_detect(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("page_id", chunking.detect_language(F.col("text")).alias("lang"))


def _sentences(split: Callable) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _texts(spark, folder).select("page_id", F.posexplode_outer(split(F.col("text"))).alias("pos", "sentence")).filter(F.col("pos").isNotNull()).select("page_id", F.col("pos").cast("bigint").alias("pos"), "sentence")

    return run


def long_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 64 tokens with 8 shared, of every chunk's content."""
    chunks = _contents(spark, folder).filter(~is_blank(F.col("content")))
    cut = chunks.select("id", tokens_of(F.col("content")).alias("t"))
    windows = cut.select("id", F.posexplode_outer(chunking.long_windows(F.col("t"), SMALL.limit, SMALL.overlap)).alias("pos", "w")).filter(F.col("pos").isNotNull())
    return windows.select("id", F.col("pos").cast("bigint").alias("pos"), F.array_join("w", " ").alias("content"), F.size("w").cast("bigint").alias("tokens"))


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("file_hash", "filename", "page_number", "text")


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all pages by the Arrow packer."""
    return chunking.chunk_pages(_cleaned(spark, folder), SMALL)


def chunk_pack_native(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a fold of built-in expressions."""
    return chunking.chunk_pages(_cleaned(spark, folder), SMALL, native=True)


def chunk_pack_subword(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all pages in the tokens of a public sub-word vocabulary."""
    return chunking.chunk_pages(_cleaned(spark, folder), SMALL, packer=chunking.pack_udf(SMALL, tokenizers.SubWord()))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbering alone: every sentence as a chunk."""
    s = _texts(spark, folder).select("page_id", "filename", "page_number", F.posexplode_outer(chunking.split_english_sentences(F.col("text"))).alias("pos", "s")).filter(F.col("pos").isNotNull())
    number = chunking.chunk_number(F.col("page_number"), F.col("pos"))
    return s.select("page_id", chunking.chunk_key(F.col("filename"), F.col("page_number"), number).alias("id"), number.cast("bigint").alias("chunk_id"))


def chunk_min_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose tokens and two special ones are 75 at least."""
    return _contents(spark, folder).filter(chunking.long_enough(F.col("content"))).select("id")


def truncate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _contents(spark, folder).filter(F.col("content").isNotNull())
    return chunks.select("id", F.array_join(chunking.truncate(tokens_of(F.col("content")), 16), " ").alias("head"))


def embed_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return _contents(spark, folder).select("id", embedding.add_prefix(F.col("content")).alias("passage"), embedding.add_prefix(F.col("content"), True).alias("query"))


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Length before, and numbers after, of every vector of the right length."""
    rows = load(spark, folder, "vector_index").filter(retrieval.usable_vector(F.col("embedding"), 64))
    unit = rows.select("id", F.posexplode_outer(embedding.l2_normalize(F.col("embedding"))).alias("pos", "x")).filter(F.col("pos").isNotNull())
    return unit.select("id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def embed_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all contents by the stand-in embedder."""
    return embedding.embed_documents(_contents(spark, folder), embedding.HashingEmbedder(64)).select("id", "embedding")


def zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Which contents get the zero vector: the blank ones."""
    e = embed_hash(spark, folder)
    return e.select("id", F.forall("embedding", lambda x: x == 0).alias("zero")).join(load(spark, folder, "chunks").select("id", is_blank(F.col("content")).alias("blank")).distinct(), "id").filter("blank").select("id", "zero")


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten rows nearest to vector 0."""
    e = load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter(F.col("id") == 0).first()
    near = retrieval.knn(e, [float(x) for x in q["embedding"]] if q else [1.0] * 64, 10)
    return near.select("id", F.round("score", 6).alias("score"))


def knn_multi_query(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest others of every row whose id is divisible by 100, against all rows."""
    e = load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.knn_many(e, e.filter(F.col("id") % 100 == 0), 5, "id").select("query", "id", F.round("score", 6).alias("score"))


def ann_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten rows nearest to vector 0 by an approximate index of all rows."""
    e = load(spark, folder, "embeddings")
    q = e.filter(F.col("vec_id") == 0).first()
    index = VectorIndex.build(e, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id", dim=64)
    return index.search([float(x) for x in q["embedding"]] if q else [1.0] * 64, 10).select("id", F.round("score", 6).alias("score"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(load(spark, folder, "vector_index"))


def _query_vector(docs: DataFrame) -> list[float]:
    """The vector of the first usable row by id; a table without one has nothing to be near to, so any will do."""
    row = docs.filter(retrieval.usable_vector(F.col("embedding"), 64)).agg(F.min_by("embedding", "id").alias("v")).first()
    return [float(x) for x in row["v"] or [1.0] * 64]


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Of each word of the chunks: in how many it stands, and how often."""
    p = retrieval.postings(_contents(spark, folder))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.top_k(retrieval.bm25(_docs(spark, folder), QUERY_TEXT), CANDIDATES).select("id", F.round("score", 6).alias("score"))


def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The same from postings."""
    docs = _docs(spark, folder)
    scored = retrieval.bm25_indexed(retrieval.postings(docs), retrieval.lengths(docs), QUERY_TEXT)
    return retrieval.top_k(scored, CANDIDATES).select("id", F.round("score", 6).alias("score"))


def minmax_norm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    near = retrieval.knn(docs, _query_vector(docs), CANDIDATES).withColumn("leg", F.lit("vector"))
    return retrieval.min_max(near).select("id", F.round("norm", 6).alias("norm"))


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return retrieval.hybrid(docs, QUERY_TEXT, _query_vector(docs), CANDIDATES).select("id", F.round("score", 6).alias("score"))


def hybrid_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Both legs over rows of first pages alone."""
    docs = _docs(spark, folder)
    return retrieval.hybrid(docs, QUERY_TEXT, _query_vector(docs), CANDIDATES, {"page_number": 1}).select("id", F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return retrieval.project_hits(docs, retrieval.hybrid(docs, QUERY_TEXT, _query_vector(docs), LIMIT * Config().overfetch))


def hit_projection(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("id", "document_id", F.length("content").cast("bigint").alias("chars"), F.col("metadata.filename").alias("filename"), F.col("metadata.page_number").cast("bigint").alias("page_number"), F.round("score", 6).alias("score"))


def rerank_order(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.rerank(_hits(spark, folder), QUERY_TEXT)
    return ranked.select("id", F.col("rank").cast("bigint").alias("rank"), F.round("rerank_score", 6).alias("rerank_score"))


def search_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """The whole search: legs, fusion, rerank and roll-up by document."""
    docs = _docs(spark, folder)
    found = search.search_table(docs, QUERY_TEXT, _query_vector(docs), LIMIT)
    return found.select("document_id", "document_name", "chunks", F.round("semantic_score", 6).alias("semantic_score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("first_rank").cast("bigint").alias("first_rank"))


def _index(spark: SparkSession, folder: str) -> Index:
    index = Index.create(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 64)
    index.append(_docs(spark, folder).filter(retrieval.usable_vector(F.col("embedding"), 64) & F.col("metadata.filename").isNotNull()))
    return index


def index_append(spark: SparkSession, folder: str) -> DataFrame:
    """An index made of all usable rows, read back: rows by document."""
    return _index(spark, folder).chunks().groupBy("document_id").agg(F.count("*").alias("rows"))


def delete_by_filename(spark: SparkSession, folder: str) -> DataFrame:
    """The same after the file that sorts first was deleted."""
    index = _index(spark, folder)
    if name := index.files().agg(F.min("filename")).first()[0]:
        index.delete_by_filename(name)
    return index.chunks().groupBy("document_id").agg(F.count("*").alias("rows"))


def upsert_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks where rows of the index take the place of those with the same id."""
    new = load(spark, folder, "vector_index").select("id", F.lit("index").alias("origin"))
    return upsert.upsert(load(spark, folder, "chunks").select("id").distinct().withColumn("origin", F.lit("chunks")), new, "id")


def one_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rows of file_meta that share a file hash, the least by name, title and author."""
    meta = load(spark, folder, "file_meta").select("file_hash", "filename", "title", "author")
    return upsert.one_per_key(meta, "file_hash", ("filename", "title", "author"))


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest(load(spark, folder, "jobs")).select("job_id", "status", F.unix_micros("updated_at").alias("at"))


def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the metadata of their file, one row of several alike."""
    meta = ingest.file_metadata(load(spark, folder, "file_meta"), "title", "author")
    return _pages(spark, folder).join(meta, "file_hash", "left").select("page_id", "title", "author")


def ingest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All pages cleaned, chunked, embedded and joined with their file's metadata."""
    files = load(spark, folder, "file_meta")
    small = Config(dimension=64, safe_limit=SMALL.limit, overlap=SMALL.overlap, minimum=SMALL.minimum)
    rows = ingest.ingest_pages(_texts(spark, folder), files, embedding.HashingEmbedder(64), small)
    return rows.select("id", "document_id", "page_number", "chunk_id", "content")


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each chunk as the lexical leg counts them."""
    return _contents(spark, folder).select("id", F.coalesce(F.size(terms_of(F.col("content"))), F.lit(0)).cast("bigint").alias("dl"))


def queries() -> dict[str, Query]:
    named = (
        clean_dispatch, clean_pages, clean_pages_bulk, noise_fit, noise_remove, route_scanned, english_ocr_valid, blank_filter, file_hash, dedup_reject, existing_semi,
        metadata_filter, language_detect, long_windows, chunk_pack, chunk_pack_native, chunk_pack_subword, chunk_ids, chunk_min_filter, truncate_tokens, embed_prefix, l2_normalize, embed_hash, zero_fill,
        knn_topk, ann_topk, knn_multi_query, postings, term_counts, bm25_topk, bm25_postings, minmax_norm, hybrid_topk, hybrid_filtered, hit_projection, rerank_order, search_end_to_end, index_append,
        delete_by_filename, upsert_by_id, one_per_key, job_status, page_metadata, ingest_rows,
    )
    texts = {name: _text_query(step) for name, step in {**TEXT_STEPS, **NFKC_STEPS}.items()}
    split = {"sentences_en": _sentences(chunking.split_english_sentences), "sentences_urdu": _sentences(chunking.split_urdu_sentences)}
    return texts | split | {f.__name__: f for f in named}
