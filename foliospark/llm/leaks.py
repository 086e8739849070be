"""Evaluation texts inside training text (problem 9).

Size-partitioned MinHash containment search. A leak is 13 words in a row, so the sets that are compared are windows of that size, nine
five-word shingles each, and a document of any length is a series of them. The signature of a window is its least shingle hash under each
of several hash functions: a window that stands in a document has the same set and so agrees in every one, hence none is missed, while
others agree in all of them only by chance. Items are partitioned by size, in powers of two of their windows, and each partition has its
own least number of windows that a containment asks for. A bit table of the items' signatures, built on the executors, drops nearly all
windows of the corpus where they are read; the rest meet the items in a join by signature. Pairs are verified by the exact containment of
13-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import ODD, Words, mix, words
from foliospark.session import materialise

WINDOW, SHINGLE = 13, 5
#: Hash functions of a signature.
HASHES = 4
#: Bits of the table for each signature of an item, and in all: beyond, it only lets more through.
BITS_EACH, MOST_BITS = 32, 1 << 28


def signatures(w: Words, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words within one text: the index of its first word, and the hash of its signature."""
    if len(w.hash) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashed = w.runs(shingle)
    count = window - shingle + 1
    first = np.flatnonzero(w.row[window - 1 :] == w.row[: len(w.row) - window + 1])
    out = np.zeros(len(first), np.uint64)
    every = np.full(len(w.hash), np.iinfo(np.uint64).max, np.uint64)
    for f in range(HASHES):
        every[at] = mix(hashed * ODD) if f else hashed
        hashed = every[at]
        least, span = every, 1
        while span * 2 <= count:  # least of 2, 4, 8 ... neighbours
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        size = len(w.hash) - window + 1
        out = mix(out ^ np.minimum(least[:size], least[count - span :][:size])[first])
    return first, out


def shingle_text(w: Words, at: int, window: int = WINDOW) -> str:
    return " ".join(w.text(at + j) for j in range(window))


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _windows(texts: DataFrame, kind: str, bits=None) -> DataFrame:
    """key, size (windows of the text), signature, shingle: the windows of each text; with bits those that the table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else bits.value
        for batch in batches:
            for b in _parts(batch):
                w = words(b.column("text"))
                first, sign = signatures(w)
                size = np.bincount(w.row[first], minlength=b.num_rows)
                if table is not None:
                    at = sign & np.uint64(64 * len(table) - 1)
                    hit = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    first, sign = first[hit > 0], sign[hit > 0]
                row = w.row[first]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array(size[row]), pa.array(sign.view(np.int64)), pa.array([shingle_text(w, i) for i in first], pa.string())], ["key", "size", "signature", "shingle"])

    return texts.mapInArrow(run, f"key {kind}, size bigint, signature bigint, shingle string")


def _bit_table(index: DataFrame) -> np.ndarray:
    """A bit for each signature: put together word by word on the executors; MOST_BITS bounds what comes to the driver."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * index.count()).bit_length()))
    at = F.col("signature").bitwiseAND(F.lit(size - 1))
    words_of = index.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(signature & 63 AS int))").alias("bits"))
    got = words_of.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", containment: float = 0.0) -> DataFrame:
    """doc, item, windows, containment: each document that holds 13 consecutive words of an item, how many of the item's windows it
    holds, and their share of the item's windows, which is at least the containment asked for.

    Null and empty texts and items under 13 words leak nowhere; repeated rows count once per key; rows without a key and empty tables give
    no rows; other columns are not read. An item key with several texts counts all of them.
    """
    tests = items.select(F.col(item).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("key").isNotNull()).distinct()
    docs = documents.select(F.col(doc).alias("key"), F.col(text).alias("text")).filter((F.length("text") >= 2 * WINDOW - 1) & F.col("key").isNotNull())
    index = materialise(_windows(tests, items.schema[item].dataType.simpleString()).withColumnRenamed("key", "item"), "items")
    bits = documents.sparkSession.sparkContext.broadcast(_bit_table(index))
    sizes = index.groupBy("item").agg(F.count_distinct("shingle").alias("all"))
    tested = index.select("item", "signature", "shingle").distinct().join(sizes, "item").withColumn("part", F.floor(F.log2("all")).cast("int"))
    met = _windows(docs, documents.schema[doc].dataType.simpleString(), bits).select(F.col("key").alias("doc"), "signature", "shingle").distinct()
    pairs = met.join(tested.withColumnRenamed("shingle", "there"), "signature")
    counted = pairs.groupBy("doc", "item", "part", "all").agg(F.count("*").alias("likely"), F.count(F.when(F.col("shingle") == F.col("there"), 1)).alias("windows"))
    # the partition's bound on the number of windows comes before the exact share
    least = F.greatest(F.lit(1), F.ceil(F.lit(containment) * F.pow(F.lit(2.0), "part")))
    sure = counted.filter((F.col("likely") >= least) & (F.col("windows") > 0)).withColumn("containment", F.col("windows") / F.col("all")).filter(F.col("containment") >= containment)
    return sure.select(F.col("doc").alias(doc), F.col("item").alias(item), "windows", "containment")
