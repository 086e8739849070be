"""Cleaning of page text: scalar functions from Column to Column, all of them built-in expressions but NFKC.

Every function gives null for null and the empty text for the empty text. The order inside the chains is significant: see each chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import encoding
from foliospark.functions.regex import DIGIT, SPACE, SPACE_SET, WORD, lines_of, py_strip, replace

Step = Callable[[Column], Column]

# The patterns that define the cleaning steps.
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
STRUCTURAL = rf"(?m)^[^a-zA-Z0-9{SPACE_SET}]{{3,}}[^\n]*$"
#: The magazine whose footers are removed by default; another name makes another pattern.
PUBLICATION = "PIA Safety e-Magazine"


def publication_footer(name: str = PUBLICATION) -> str:
    return rf"{name}{SPACE}*\|{SPACE}*Issue-{DIGIT}+[^\n]*"


PUBLICATION_FOOTER = publication_footer()
PAGE_FOOTER = rf"{DIGIT}+{SPACE}*\|{SPACE}*P{SPACE}*a{SPACE}*g{SPACE}*e"
NUMBER_LINE = rf"(?m)^{SPACE}*{DIGIT}+{SPACE}*$"
HYPHENATION = rf"({WORD}+)-\n({WORD}+)"
LONE_BREAK, MANY_BREAKS = r"(?<!\n)\n(?!\n)", r"\n{3,}"
BLANKS = r"[ \t]+"
PAGE_LABEL = rf"(?i)page{SPACE}+{DIGIT}+({SPACE}+of{SPACE}+{DIGIT}+)?"
RULES = r"[_\-*=.]{3,}"
NUMBER_DOT, NUMBER_DASH, NUMBER_PERCENT = rf"({DIGIT}){SPACE}+\.{SPACE}+({DIGIT})", rf"({DIGIT}){SPACE}*-{SPACE}*({DIGIT})", rf"({DIGIT}){SPACE}+%"
SPACED_LETTERS = rf"(?<!{WORD})(?:[A-Za-z]{SPACE}){{2,}}[A-Za-z](?!{WORD})"
ZERO_AS_O, ONE_AS_L = rf"(?<=\P{{Nd}})0(?=\P{{Nd}})", rf"(?<=\P{{Nd}})1(?=\P{{Nd}})"
URDU_MARKS = r"[\^~|&]"
ALNUM = r"[\p{L}\p{N}]"
HEADER_FOOTERS = (PUBLICATION_FOOTER, PAGE_FOOTER, NUMBER_LINE)


def _arrow(step: Callable[[str], str]) -> Step:
    """A step in Python, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else step(t) for t in s], dtype=object)

    return run


def nfkc(text: Column) -> Column:
    """Compatibility composition; with the repair of encodings the one step that needs Python."""
    return _arrow(encoding.nfkc)(text)


def fix_mojibake(text: Column) -> Column:
    """Repair of wrong encodings: by the ftfy library where the workers have it, else the engine's own."""
    return _arrow(lambda t: encoding.fixer()(t))(text)


def private_use_to_space(text: Column) -> Column:
    return replace(text, PRIVATE_USE, " ")


def clean_encoding(text: Column) -> Column:
    return private_use_to_space(_arrow(lambda t: encoding.nfkc(encoding.fixer()(t)))(text))


def strip_structural_noise(text: Column) -> Column:
    """Blanks lines whose first three characters are neither ASCII letters or digits nor white space."""
    return replace(text, STRUCTURAL)


def remove_headers_footers(text: Column, patterns: tuple[str, ...] = HEADER_FOOTERS) -> Column:
    return reduce(replace, patterns, text)


def fix_hyphenation(text: Column) -> Column:
    """Joins a word cut by a hyphen right before a line feed; the right part is consumed, so it can't be the left part of the next."""
    return replace(text, HYPHENATION, "$1$2")


def normalize_linebreaks(text: Column) -> Column:
    return replace(replace(text, LONE_BREAK, " "), MANY_BREAKS, "\n\n")


def normalize_whitespace(text: Column) -> Column:
    return py_strip(replace(text, BLANKS, " "))


def deduplicate_paragraphs(text: Column) -> Column:
    """Keeps the first of equal paragraphs, in order, without blank ones."""
    stripped = F.filter(F.transform(F.split(text, "\n\n", -1), py_strip), lambda p: p != "")
    return F.array_join(F.array_distinct(stripped), "\n\n")


def clean_formatting_artifacts(text: Column) -> Column:
    return replace(replace(text, PAGE_LABEL), RULES, " ")


def remove_short_lines(text: Column, min_length: int = 2) -> Column:
    return F.array_join(F.filter(lines_of(text), lambda x: F.length(py_strip(x)) >= min_length), "\n")


def fix_numeric_spacing(text: Column) -> Column:
    return replace(replace(replace(text, NUMBER_DOT, "$1.$2"), NUMBER_DASH, "$1-$2"), NUMBER_PERCENT, "$1%")


def fix_letter_spacing(text: Column) -> Column:
    """Closes runs of three or more single letters; only spaces go, tabs and line feeds inside the run stay."""
    between = F.split(text, SPACED_LETTERS, -1)
    runs = F.transform(F.regexp_extract_all(text, F.lit(SPACED_LETTERS), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    return F.array_join(F.zip_with(between, runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def fix_common_ocr_confusions(text: Column) -> Column:
    """Zero and one between characters that are no digits become O and l."""
    return replace(replace(text, ZERO_AS_O, "O"), ONE_AS_L, "l")


def remove_garbage_lines(text: Column) -> Column:
    """Drops lines that are too short or hold no letter or digit."""
    return F.array_join(F.filter(lines_of(text), lambda x: (F.length(py_strip(x)) >= 2) & x.rlike(ALNUM)), "\n")


def remove_urdu_marks(text: Column) -> Column:
    return replace(text, URDU_MARKS)


def collapse_whitespace(text: Column) -> Column:
    return replace(text, f"{SPACE}+", " ")


#: Chains without the encoding step. In the digital chain short lines go after line breaks are normalised, which also takes the blank
#: lines, so that paragraphs are deduplicated only within what is then one; in the OCR chain a page becomes one line.
DIGITAL: tuple[Step, ...] = (fix_hyphenation, remove_headers_footers, clean_formatting_artifacts, strip_structural_noise, normalize_linebreaks, remove_short_lines, deduplicate_paragraphs, fix_numeric_spacing, normalize_whitespace)
OCR: tuple[Step, ...] = (fix_hyphenation, fix_letter_spacing, fix_common_ocr_confusions, remove_garbage_lines, normalize_linebreaks, fix_numeric_spacing, normalize_whitespace)
URDU: tuple[Step, ...] = (remove_urdu_marks, collapse_whitespace)


def chain(text: Column, steps: tuple[Step, ...]) -> Column:
    return reduce(lambda c, step: step(c), steps, text)


def preprocess_digital(text: Column, noise_cleaner: Step | None = None, encode: Step = clean_encoding) -> Column:
    """The digital chain; a learned noise cleaner comes right after headers and footers."""
    steps = DIGITAL if noise_cleaner is None else (*DIGITAL[:2], noise_cleaner, *DIGITAL[2:])
    return chain(encode(text), steps)


def preprocess_ocr(text: Column, encode: Step = clean_encoding) -> Column:
    return chain(encode(text), OCR)


def preprocess_urdu_ocr(text: Column, encode: Step = clean_encoding) -> Column:
    return chain(encode(text), URDU)


def preprocess_page(text: Column, source_type: Column, encode: Step = clean_encoding) -> Column:
    """The chain of the source type; unknown and null types leave the text as it is.

    The encoding step, the only one in Python, is applied once and below the choice of the chain.
    """
    clean = encode(text)
    return F.when(source_type == "digital", chain(clean, DIGITAL)).when(source_type == "ocr", chain(clean, OCR)).when(source_type == "urdu_ocr", chain(clean, URDU)).otherwise(text)


