"""Character classes that mean the same in Java, RE2 and Python's regular expressions, and Column helpers built on them.

Written out as code points, a class needs no flags; multi-line patterns get Java's flag for plain line feeds from ``java``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, word characters and digits in the sense of Unicode-aware Python patterns. Fixed values.
SPACE_SET = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_SET = r"\p{L}\p{N}_"
SPACE, NOT_SPACE = f"[{SPACE_SET}]", f"[^{SPACE_SET}]"
WORD, NOT_WORD = f"[{WORD_SET}]", f"[^{WORD_SET}]"
DIGIT = r"\p{Nd}"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"
TOKEN = rf"{NOT_SPACE}+"
TERM = rf"{WORD}+"


def java(pattern: str) -> str:
    """A pattern with multi-line anchors for Spark: only a line feed ends a line."""
    return pattern.replace("(?m)", "(?md)") if "(?m)" in pattern else pattern


def replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(java(pattern)), F.lit(by))


def py_strip(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return replace(text, STRIP)


def is_blank(text: Column) -> Column:
    """True for null and for text of white space alone."""
    return F.coalesce(~text.rlike(NOT_SPACE), F.lit(True))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def tokens_of(text: Column) -> Column:
    """Runs of what is not white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def terms_of(text: Column) -> Column:
    """Words in lower case, as a lexical index has them."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
