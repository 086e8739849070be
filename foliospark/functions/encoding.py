"""The encoding step of cleaning: UTF-8 that was read as Windows-1252 or Latin-1 is turned back, layer by layer.

Where the ftfy library is installed on the workers, it does this instead.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache


@cache
def _bytes() -> dict[str, int]:
    """Windows-1252 with Latin-1 in its gaps: from character to byte."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        out |= {c: b for c in bytes([b]).decode("cp1252", "ignore")}
    return out


@cache
def _sequences() -> re.Pattern:
    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in _bytes().items() if low <= b <= high) + "]"

    more = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}})+")


def _usual(c: str) -> bool:
    """Letters of Europe's Latin alphabets and usual signs: one alone is believed."""
    return ord(c) < 0x180 or 0x2010 <= ord(c) < 0x2040 or c in "€™" or ord(c) >= 0x1F300


def _decoded(m: re.Match) -> str:
    try:
        new = bytes(_bytes()[c] for c in m.group()).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()
    kinds = [unicodedata.category(c) for c in new]
    if any(k in ("Cn", "Co", "Cs") for k in kinds):
        return m.group()
    # letters of other scripts are believed in company only
    return new if all(map(_usual, new)) or sum(k[0] in "LM" for k in kinds) > 1 else m.group()


def fix_encoding(text: str) -> str:
    """The text with all layers taken off; every layer makes it shorter."""
    while not text.isascii() and (new := _sequences().sub(_decoded, text)) != text:
        text = new
    return text


@cache
def fixer() -> Callable[[str], str]:
    """What this worker repairs encodings with."""
    try:
        import ftfy
    except ImportError:
        return fix_encoding
    return ftfy.fix_text


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)
