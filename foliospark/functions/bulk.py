"""The cleaning chains as Arrow functions: for bulk ingest, where long chains of expressions cost more than one trip to Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import cleaning as C
from foliospark.functions import encoding


@cache
def _compiled(pattern: str) -> re.Pattern:
    """One of the shared patterns in the dialect of Python."""
    p = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", pattern)
    for java, python in ((r"[\p{L}\p{N}_]", r"\w"), (r"[\p{L}\p{N}]", r"[^\W_]"), (r"\p{Nd}", r"\d"), (r"\P{Nd}", r"\D")):
        p = p.replace(java, python)
    return re.compile(p)


def _sub(pattern: str, by: str = "") -> Callable[[str], str]:
    found, by = _compiled(pattern), re.sub(r"\$(\d)", r"\\\1", by)
    return lambda t: found.sub(by, t)


def _keep_lines(test: Callable[[str], bool]) -> Callable[[str], str]:
    return lambda t: "\n".join(x for x in t.split("\n") if test(x))


def _paragraphs(text: str) -> str:
    return "\n\n".join(dict.fromkeys(p.strip() for p in text.split("\n\n") if p.strip()))


def _letters(text: str) -> str:
    return _compiled(C.SPACED_LETTERS).sub(lambda m: m.group().replace(" ", ""), text)


@cache
def single() -> dict[str, list[Callable[[str], str]]]:
    """Every cleaning step by the name it has in cleaning, as functions of Python."""
    alnum = _compiled(C.ALNUM)
    return {
        "fix_mojibake": [lambda t: encoding.fixer()(t)],
        "nfkc": [encoding.nfkc],
        "private_use_to_space": [_sub(C.PRIVATE_USE, " ")],
        "clean_encoding": [lambda t: encoding.nfkc(encoding.fixer()(t)), _sub(C.PRIVATE_USE, " ")],
        "strip_structural_noise": [_sub(C.STRUCTURAL)],
        "remove_headers_footers": [_sub(p) for p in C.HEADER_FOOTERS],
        "fix_hyphenation": [_sub(C.HYPHENATION, "$1$2")],
        "normalize_linebreaks": [_sub(C.LONE_BREAK, " "), _sub(C.MANY_BREAKS, "\n\n")],
        "normalize_whitespace": [_sub(C.BLANKS, " "), str.strip],
        "deduplicate_paragraphs": [_paragraphs],
        "clean_formatting_artifacts": [_sub(C.PAGE_LABEL), _sub(C.RULES, " ")],
        "remove_short_lines": [_keep_lines(lambda x: len(x.strip()) >= 2)],
        "fix_numeric_spacing": [_sub(C.NUMBER_DOT, "$1.$2"), _sub(C.NUMBER_DASH, "$1-$2"), _sub(C.NUMBER_PERCENT, "$1%")],
        "fix_letter_spacing": [_letters],
        "fix_common_ocr_confusions": [_sub(C.ZERO_AS_O, "O"), _sub(C.ONE_AS_L, "l")],
        "remove_garbage_lines": [_keep_lines(lambda x: len(x.strip()) >= 2 and bool(alnum.search(x)))],
        "remove_urdu_marks": [_sub(C.URDU_MARKS)],
        "collapse_whitespace": [lambda t: re.sub(r"\s+", " ", t)],
    }


@cache
def steps() -> dict[str, list[Callable[[str], str]]]:
    """The chains by source type, encoding step included: the steps of cleaning's chains in their order."""
    chains = {"digital": C.DIGITAL, "ocr": C.OCR, "urdu_ocr": C.URDU}
    return {kind: [f for name in ("clean_encoding", *(step.__name__ for step in chain)) for f in single()[name]] for kind, chain in chains.items()}


def clean(text: str | None, source_type: str | None) -> str | None:
    if text is None:
        return None
    for step in steps().get(source_type, ()):
        text = step(text)
    return text


@F.pandas_udf(T.StringType())
def _clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, kind in batches:
        yield pd.Series([clean(t, k) for t, k in zip(text, kind, strict=True)], dtype=object)


def preprocess_page_bulk(text: Column, source_type: Column) -> Column:
    """The same results as cleaning.preprocess_page, in one Arrow function.

    Marked as not deterministic, so that filters on its result don't run it again below.
    """
    return _clean.asNondeterministic()(text, source_type)
