"""Declared schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("file_hash", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("source_type", T.StringType()),
])
FILES = T.StructType([
    T.StructField("file_hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("creation_date", T.TimestampType()),
    T.StructField("filename", T.StringType()),
])
CHUNKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("chunk_id", T.IntegerType()),
])
METADATA = T.StructType([*FILES.fields, T.StructField("page_number", T.IntegerType()), T.StructField("chunk_id", T.IntegerType())])
INDEX = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", METADATA)])
JOBS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])
#: What a page provider gives for one file.
EXTRACTED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("creation_date", T.TimestampType()),
    T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_type", T.StringType()),
    ]))),
    T.StructField("error", T.StringType()),
])
