"""Predicates and guards on pages, files and queries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.regex import is_blank, py_strip

ENGLISH_WORD = r"[a-z]{3,}"


def text_length(text: Column) -> Column:
    """Length of the stripped text, 0 for null."""
    return F.coalesce(F.length(py_strip(text)), F.lit(0))


def is_scanned(text: Column, has_image: Column, min_text_chars: int = 50) -> Column:
    """Little text (unstripped) and an image on the page; null text has length 0."""
    return (F.coalesce(F.length(text), F.lit(0)) < min_text_chars) & F.coalesce(has_image, F.lit(False))


def english_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ENGLISH_WORD), F.lit(0))


def is_valid_english_ocr(text: Column, dictionary: Column, min_words: int = 10, max_unknown: float = 0.5) -> Column:
    """Enough words, and distinct unknown ones are at most the given share of all; dictionary is an array column (a bounded one)."""
    words = english_words(text)
    unknown = F.size(F.array_except(F.array_distinct(words), dictionary))
    return (F.size(words) >= min_words) & (F.try_divide(unknown, F.size(words)) <= max_unknown)


def with_valid_english(pages: DataFrame, dictionary: DataFrame, key: str = "page_id", text: str = "text", word: str = "word", min_words: int = 10, max_unknown: float = 0.5) -> DataFrame:
    """key, words, unknown, valid: is_valid_english_ocr against a dictionary of any size, by a join on the distinct words.

    Keys must be unique; null text has no words and is not valid.
    """
    counted = pages.select(F.col(key), english_words(F.col(text)).alias("w"))
    exploded = counted.select(key, F.explode_outer(F.array_distinct("w")).alias(word)).filter(F.col(word).isNotNull())
    missing = exploded.join(dictionary.select(word).distinct(), word, "left_anti").groupBy(key).agg(F.count("*").alias("unknown"))
    joined = counted.select(key, F.size("w").alias("words")).join(missing, key, "left")
    unknown = F.coalesce("unknown", F.lit(0))
    return joined.select(key, F.col("words").cast("bigint").alias("words"), unknown.alias("unknown"), ((F.col("words") >= min_words) & (F.coalesce(F.try_divide(unknown, F.col("words")), F.lit(1.0)) <= max_unknown)).alias("valid"))


def is_urdu_text(text: Column, dictionary: Column) -> Column:
    """Whatever is no valid English, bad or short English included, counts as Urdu."""
    return ~is_valid_english_ocr(text, dictionary)


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Without rows whose text is null or white space; the test reads the input column, so it is pushed below later steps."""
    return df.filter(~is_blank(F.col(text)))


def metadata_filter(filters: dict[str, object] | None, column: str = "metadata") -> Column:
    """Equality on each named field of the metadata struct, all of them; no filters let everything through."""
    return reduce(and_, [F.col(f"{column}.{k}") == F.lit(v) for k, v in (filters or {}).items()], F.lit(True))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of files whose file_hash and filename are both unknown."""
    by_hash = known.select("file_hash").filter(F.col("file_hash").isNotNull()).distinct()
    by_name = known.select("filename").filter(F.col("filename").isNotNull()).distinct()
    return files.join(by_hash, "file_hash", "left_anti").join(by_name, "filename", "left_anti")


def known_files(files: DataFrame, known: DataFrame, on: str = "file_hash") -> DataFrame:
    """Rows of files whose key is known."""
    return files.join(known.select(on).distinct(), on, "left_semi")


def require_text(text: str | None, what: str = "text") -> str:
    """The driver-side guard for a single blank text."""
    if text is None or not text.strip():
        raise ValueError(f"{what} is blank")
    return text
