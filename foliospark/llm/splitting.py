"""Items over a size limit cut into overlapping pieces at natural boundaries (problem 7).

Recursive bisection: the strongest boundary near the middle is the cut; halves that still exceed the limit less the overlap are cut
again; then each piece after the first is begun 50 to 100 characters earlier, at the start of a word where there is one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; the cut comes after the match. Fixed values.
BOUNDARIES = (r"\n[^\S\n]*\n\s*", r"\n+", r"[.!?۔؟]+[\"'”’»)\]]*\s+", r"[;:؛]\s+", r"[,،]\s+", r"\s+", r"[-‐–—/]")
_PATTERNS = [re.compile(b) for b in BOUNDARIES]


def _inside_character(text: str, at: int) -> bool:
    """Whether a cut at this place would part a base character from its marks or a joined sequence."""
    c, before = text[at], text[at - 1]
    return unicodedata.combining(c) != 0 or c in "‍︎️" or before == "‍" or 0x1F3FB <= ord(c) <= 0x1F3FF or (before == "\r" and c == "\n")


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Inner cut positions, so that the first part has at most limit characters and every other at most limit - overlap."""
    if len(text) <= limit:
        return []
    marks = [[m.end() for m in p.finditer(text)] for p in _PATTERNS]
    found: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 else limit - overlap):
            continue
        mid, reach = (a + b) // 2, (b - a) // 4
        best = None
        for at in marks:
            lo = bisect_left(at, mid - reach)
            near = at[lo : bisect_left(at, mid + reach + 1, lo)]
            if near:
                best = min(near, key=lambda x: (abs(x - mid), x))
                break
        if best is None:
            best = mid
            while best > a + 1 and _inside_character(text, best):
                best -= 1
            if best == a + 1 and _inside_character(text, best):
                best = mid
        found.append(best)
        todo += [(best, b), (a, best)]
    return sorted(found)


def pieces(text: str, limit: int = 1200, least: int = 50, most: int = 100) -> list[tuple[int, int]]:
    """(begin, end) of each piece; a text within the limit is one piece."""
    at = [0, *cuts(text, limit, most), len(text)]
    out = [(0, at[1])]
    for a, b in zip(at[1:], at[2:], strict=False):
        low, high = max(out[-1][0] + 1, a - most), a - least
        begin = low
        if high > low:
            begin = next((x for x in range(high, low - 1, -1) if text[x - 1].isspace() and not text[x].isspace()), None) or next((x for x in range(high, low - 1, -1) if not _inside_character(text, x)), high)
        out.append((begin, b))
    return out


def split_oversized(df: DataFrame, key: str = "id", text: str = "content", keep: tuple[str, ...] = ("document_id", "page_number"), limit: int = 1200, least: int = 50, most: int = 100) -> DataFrame:
    """key, the kept columns, piece_no (from 1), pieces, begin, end (0-based, end excluded) and piece of every distinct row with text.

    Sizes are in code points. Rows within the limit are one piece and never leave the JVM. Rows that are equal in all the columns used
    count once. Null text gives no row, empty text one empty piece. A cut never parts a base character from its marks unless the whole
    stretch is one such sequence. Extra columns are not read.
    """
    rows = df.select(key, *keep, text).filter(F.col(text).isNotNull())
    heads = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(key, *keep).schema]
    schema = ", ".join([*heads, "piece_no int", "pieces int", "begin int", "end int", "piece string"])
    short = rows.filter(F.length(text) <= limit).select(
        key, *keep, F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("begin"), F.length(text).alias("end"), F.col(text).alias("piece")
    ).dropDuplicates([key, *keep, "piece"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, no, count, begin, end, part = [], [], [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                spans = pieces(t, limit, least, most)
                for k, (x, y) in enumerate(spans, 1):
                    take.append(i), no.append(k), count.append(len(spans)), begin.append(x), end.append(y), part.append(t[x:y])
            head = [b.column(c).take(pa.array(take, pa.int64())) for c in (key, *keep)]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, pa.int32()) for x in (no, count, begin, end)), pa.array(part, pa.string())], [key, *keep, "piece_no", "pieces", "begin", "end", "piece"])

    long = rows.filter(F.length(text) > limit).dropDuplicates().mapInArrow(cut, schema)
    return short.unionByName(long)


def oversized(df: DataFrame, key: str = "id", text: str = "content", limit: int = 1200) -> DataFrame:
    """The distinct keys whose text was cut."""
    long = df.filter(F.length(text) > limit)  # what is within the limit has one piece
    return split_oversized(long, key, text, limit=limit).filter((F.col("pieces") > 1) & (F.col("piece_no") == 1)).select(key).distinct()
