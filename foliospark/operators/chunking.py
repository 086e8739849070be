"""Language routing, sentences and token-window chunks of pages.

A chunk never crosses a page. Sentences are packed greedily up to a limit of tokens; a full chunk hands its last tokens on as an overlap
if they fit beside the next sentence; a sentence over the limit is cut into windows. Chunks under a least size are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.regex import SPACE, is_blank, py_strip, tokens_of
from foliospark.operators.tokenizers import Tokenizer, Whitespace

URDU_END = rf"[۔?!]{SPACE}+"
ENGLISH_END = rf"(?<=[.!?]){SPACE}+"
ARABIC_LETTER, ANY_LETTER = r"[\x{600}-\x{6FF}]", r"\p{L}"


def detect_language(text: Column) -> Column:
    """ur where at least half of the letters are of the Arabic script, else en; null counts as en."""
    arabic, letters = F.regexp_count(text, F.lit(ARABIC_LETTER)), F.regexp_count(text, F.lit(ANY_LETTER))
    return F.when((arabic * 2 >= letters) & (letters > 0), F.lit("ur")).otherwise(F.lit("en"))


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), py_strip), lambda s: s != "")


def split_urdu_sentences(text: Column) -> Column:
    """Sentences; the end mark before white space is consumed, a last one without it stays."""
    return _split(text, URDU_END)


def split_english_sentences(text: Column) -> Column:
    return _split(text, ENGLISH_END)


def split_sentences(text: Column, language: Column | None = None) -> Column:
    language = detect_language(text) if language is None else language
    return F.when(is_blank(text), F.array().cast("array<string>")).when(language == "ur", split_urdu_sentences(text)).otherwise(split_english_sentences(text))


@dataclass(frozen=True)
class Windows:
    """Sizes in tokens: limit of a chunk, overlap, least size counted with special tokens."""

    limit: int = 504
    overlap: int = 50
    minimum: int = 75
    special: int = 2


def safe_limit(model_limit: int, prefix_tokens: int, reserve: int = 5) -> int:
    return model_limit - prefix_tokens - reserve


def chunk_number(page: Column, place: Column) -> Column:
    """The page number plus the place of the chunk on its page."""
    return (page + place).cast("int")


def chunk_key(filename: Column, page: Column, chunk: Column) -> Column:
    return F.concat(filename, F.lit("_"), page.cast("string"), F.lit("_"), chunk.cast("string"))


def long_enough(text: Column, w: Windows = Windows()) -> Column:
    """Whether a chunk has the least size, in white-space tokens and special ones; null has not."""
    return F.size(tokens_of(text)) + w.special >= w.minimum


def truncate(tokens: Column, limit: int) -> Column:
    return F.slice(tokens, 1, limit)


def long_windows(tokens: Column, limit: int, overlap: int) -> Column:
    """Windows of limit tokens with a stride of limit - overlap, up to the first that reaches the end; one window if all fit."""
    pieces = F.when(F.size(tokens) <= limit, F.lit(1)).otherwise(1 + F.ceil((F.size(tokens) - limit) / F.lit(limit - overlap))).cast("int")
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(tokens, i * (limit - overlap) + 1, F.lit(limit)))


def pack(sentences: list[list], w: Windows) -> list[list]:
    """Token lists of the chunks of one page, least size not yet applied."""
    out: list[list] = []
    now: list = []
    for s in sentences:
        if len(s) > w.limit:
            if now:
                out.append(now)
                now = []
            for start in range(0, len(s), w.limit - w.overlap):
                out.append(s[start : start + w.limit])
                if start + w.limit >= len(s):
                    break
        elif len(now) + len(s) <= w.limit:
            now = now + s
        else:
            if now:
                out.append(now)
            carried = now[-w.overlap :] if w.overlap else []
            now = carried + s if len(carried) + len(s) <= w.limit else s
    if now:
        out.append(now)
    return out


def whitespace_tokens(text: str) -> list[str]:
    return text.split()


def pack_udf(w: Windows = Windows(), tokenizer: Tokenizer = Whitespace()) -> Callable[[Column], Column]:
    """An Arrow function from an array of sentences to the chunks of a page, in the tokens of a tokenizer.

    The least size is counted on the text of a chunk as it is encoded again, without blanks at its ends.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def chunks(page: list) -> list[str]:
            if isinstance(tokenizer, Whitespace):  # its tokens are the same when they are encoded again
                return [" ".join(c) for c in pack([x.split() for x in page], w) if len(c) + w.special >= w.minimum]
            encoded = [tokenizer.encode(f" {x}" if i else x) for i, x in enumerate(page)]
            texts = [tokenizer.decode(c).strip() for c in pack(encoded, w)]
            return [t for t in texts if len(tokenizer.encode(t)) + w.special >= w.minimum]

        for s in batches:
            yield s.map(lambda page: [] if page is None else chunks(page))

    return run


def pack_native(sentences: Column, w: Windows = Windows()) -> Column:
    """The same as built-in expressions over white-space tokens: a fold over the sentences. For small pages and as a second opinion."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("now"), F.array().cast("array<string>").alias("out"))

    def flushed(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"])

    def step(acc: Column, sentence: Column) -> Column:
        t = tokens_of(sentence)
        carried = F.when(F.size(acc["now"]) > w.overlap, F.slice(acc["now"], -w.overlap, w.overlap)).otherwise(acc["now"]) if w.overlap else empty
        fits = F.size(carried) + F.size(t) <= w.limit
        windows = F.transform(long_windows(t, w.limit, w.overlap), lambda x: F.array_join(x, " "))
        return (
            F.when(F.size(t) > w.limit, F.struct(empty.alias("now"), F.concat(flushed(acc), windows).alias("out")))
            .when(F.size(acc["now"]) + F.size(t) <= w.limit, F.struct(F.concat(acc["now"], t).alias("now"), acc["out"].alias("out")))
            .otherwise(F.struct(F.when(fits, F.concat(carried, t)).otherwise(t).alias("now"), flushed(acc).alias("out")))
        )

    packed = F.aggregate(sentences, start, step, flushed)
    return F.filter(packed, lambda c: long_enough(c, w))


def chunk_pages(pages: DataFrame, w: Windows = Windows(), text: str = "text", native: bool = False, packer: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, document_id, content, page_number, chunk_id of every chunk.

    chunk_id is the page number plus the place on the page, so ids repeat across pages while id, which has the page too, does not.
    Blank and null pages and chunks under the least size give no row; null page numbers give null ids.
    """
    sentences = split_sentences(F.col(text))
    packed = pages.filter(~is_blank(F.col(text))).withColumn("_s", sentences).withColumn("_c", pack_native(F.col("_s"), w) if native else (packer or pack_udf(w))(F.col("_s")))
    # an inner explode would infer a filter on the packed column, which is then computed twice, and below a repartition
    exploded = packed.select("file_hash", "filename", "page_number", F.posexplode_outer("_c").alias("pos", "content")).filter(F.col("pos").isNotNull())
    chunk = chunk_number(F.col("page_number"), F.col("pos"))
    return exploded.select(chunk_key(F.col("filename"), F.col("page_number"), chunk).alias("id"), F.col("file_hash").alias("document_id"), "content", "page_number", chunk.alias("chunk_id"))
