"""Ingestion: files to pages, cleaned pages, chunks, embedded rows of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions.bulk import preprocess_page_bulk
from foliospark.functions.cleaning import preprocess_page
from foliospark.operators.chunking import Windows, chunk_pages
from foliospark.operators.embedding import Embedder, HashingEmbedder, embed_documents
from foliospark.operators.predicates import drop_blank, new_files
from foliospark.session import materialise
from foliospark.sources.index import Index, Result
from foliospark.sources.pages import Ocr, explode_pages, extract_pages, no_ocr, read_files


def clean(pages: DataFrame, bulk: bool = False) -> DataFrame:
    """Pages with cleaned text, blank ones dropped before and after. bulk takes the Arrow chain, else built-in expressions."""
    step = preprocess_page_bulk if bulk else preprocess_page
    return drop_blank(drop_blank(pages).withColumn("text", step(F.col("text"), F.col("source_type"))))


def windows(config: Config) -> Windows:
    return Windows(config.safe_limit, config.overlap, config.minimum, config.special_tokens)


def file_metadata(files: DataFrame, *columns: str) -> DataFrame:
    """file_hash and the columns, one row a file: of several rows each column's greatest value that is not null."""
    return files.groupBy("file_hash").agg(*[F.max(c).alias(c) for c in columns])


def index_rows(chunks: DataFrame, files: DataFrame, embedder: Embedder, config: Config = Config()) -> DataFrame:
    """Rows of the index: chunks with vectors and the metadata of their file, where the chunk's own fields win.

    Metadata is joined before the texts are embedded, so that no vector is shuffled.
    """
    meta = file_metadata(files.filter(F.col("file_hash").isNotNull()), "title", "author", "creation_date", "filename")
    metadata = F.struct("file_hash", "title", "author", "creation_date", "filename", "page_number", "chunk_id").alias("metadata")
    joined = chunks.join(meta, chunks["document_id"] == meta["file_hash"]).select("id", "document_id", "content", "page_number", "chunk_id", metadata)
    return embed_documents(joined, embedder, prefix=config.passage_prefix).select("id", "document_id", "content", "page_number", "chunk_id", "embedding", "metadata")


def ingest_pages(pages: DataFrame, files: DataFrame, embedder: Embedder, config: Config = Config(), bulk: bool = True) -> DataFrame:
    """From pages and file metadata to rows of the index."""
    return index_rows(chunk_pages(clean(pages, bulk), windows(config)), files, embedder, config)


def ingest_files(spark: SparkSession, index: Index, files: DataFrame, embedder: Embedder | None = None, config: Config = Config(), ocr: Ocr = no_ocr, on_conflict: str = "reject") -> tuple[Result, DataFrame]:
    """Indexes a table of files (filename, file_hash, content); gives the result and one outcome row per file.

    Files that the index knows are left out before anything is extracted. Outcomes: filename, file_hash, status, error.
    """
    embedder = embedder or HashingEmbedder(index.manifest()["dimension"])
    todo = new_files(files, index.files()) if on_conflict == "reject" else files
    extracted = materialise(extract_pages(todo, ocr), "extracted")  # read three times below, and extraction is the costly part
    rows = ingest_pages(explode_pages(extracted.filter(F.col("error").isNull())), extracted, embedder, config)
    result = index.append(rows, on_conflict)
    stored = index.files().select("file_hash", F.lit(True).alias("_in")).distinct()
    status = files.select("filename", "file_hash").join(extracted.select("file_hash", "error", F.lit(True).alias("_tried")).dropDuplicates(["file_hash"]), "file_hash", "left").join(stored, "file_hash", "left")
    reason: Column = F.when(F.col("_tried").isNull(), F.lit("duplicate file or filename")).when(F.col("error").isNotNull(), F.col("error")).when(F.col("_in").isNull(), F.lit("no text could be extracted"))
    return result, status.select("filename", "file_hash", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("error"))


def ingest(spark: SparkSession, index: Index, path: str, **options: object) -> tuple[Result, DataFrame]:
    """Indexes the PDF files under a folder."""
    return ingest_files(spark, index, read_files(spark, path), **options)  # type: ignore[arg-type]
