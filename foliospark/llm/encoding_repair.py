"""Text that went through a wrong character encoding (problem 1).

Round-trip repair. Under each candidate legacy encoding the characters of a suspect stretch are turned back into bytes and strictly
decoded as UTF-8; what gives the largest drop of a garbling cost is kept, and the step is repeated until no layer lowers the cost. An
encoding of another script than Latin is taken for the cause only on lines whose letters of that script it explains for the most part. A
second kind, single-byte text read under another single-byte encoding, is repaired word by word where words mix scripts or hold signs.
What was lost to replacement characters is reported but cannot be restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import code_points

#: Candidate encodings, the usual ones first. Fixed values.
LEGACY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "cp866")
#: Pairs of an encoding that text was read in and the one it was written in. Fixed values.
SWAPPED = (("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1256"))
ARABIC_AS_CYRILLIC = ("cp1251", "cp1256")
REPLACEMENT = "\ufffd"
#: The evidence that makes a text a misread one: a single clear place.
LEAST_GAIN = 2.5


@cache
def _table(encoding: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of an encoding (undefined bytes are control characters, as lenient decoders give them), and the way back."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return "".join(chars), back


@cache
def _pattern(encoding: str) -> re.Pattern:
    """Stretches that are whole UTF-8 sequences under the encoding."""
    chars, _ = _table(encoding)

    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c in chars[low : high + 1]) + "]"

    more = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}})+")


@cache
def script(c: str) -> str:
    """The script of a letter or of a mark of its own script; nothing for signs, digits and combining accents."""
    kind = unicodedata.category(c)
    if kind[0] not in "LM":
        return ""
    name = unicodedata.name(c, "").partition(" ")[0]
    return "" if name in ("COMBINING", "MODIFIER", "VARIATION") or kind == "Lm" and name == "SUPERSCRIPT" else name


@cache
def cost(c: str) -> float:
    """How unlikely a character is in text as it was written; letters of the corpus languages are cheap."""
    o, kind = ord(c), unicodedata.category(c)
    if o < 0x80:
        return 0.0 if o >= 32 or c in "\t\n\r" else 3.0
    if 0x80 <= o < 0xA0:
        return 6.0
    if c == REPLACEMENT:
        return 8.0
    if kind in ("Cn", "Co", "Cs"):
        return 9.0
    if 0x600 <= o < 0x700:
        return 0.5
    if 0xC0 <= o < 0x100:
        return 2.0 if c in "×÷ÐÞþð" else 1.0 if c in "äöüßÄÖÜéèêëàâçîïôûÉÈÊËÀÂÇÎÏÔÛáíóúñÁÍÓÚÑãõÃÕ" else 1.1
    if 0xA0 <= o < 0xC0:
        return 1.0 if c in "\xa0«»§°" else 1.2 if c in "±µ£©®·" else 2.0
    if c in "“”‘’–—…‚„‹›€•†™":
        return 1.0 if c in "“”‘’–—…€" else 1.5
    if 0x200B <= o <= 0x200F or 0x2028 <= o <= 0x202E or c == "\ufeff":
        return 1.5
    if c in "œŒšŠžŽŸ":
        return 1.2
    if 0x100 <= o < 0x180 or 0x1EA0 <= o < 0x1F00:
        return 1.5
    if kind[0] in "LM":
        return 6.0 if 0x180 <= o < 0x370 or 0xFB00 <= o < 0xFE70 or script(c) in ("", "LATIN") else 1.3
    if o >= 0x1F000:
        return 2.0
    if 0x2500 <= o < 0x2600 or 0x2300 <= o < 0x2400:
        return 3.5
    return 3.0 if 0x2200 <= o < 0x2300 else 2.0 if 0x2000 <= o < 0x2C00 or 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFFEF else 4.0


def total(text: str) -> float:
    return sum(map(cost, text))


def _fit(text: str, before: str, after: str) -> float:
    """The cost of a stretch between its neighbours: letters of other scripts than Latin are cheap in company, and costly alone or beside
    letters of another script."""
    out, last = total(text), len(text) - 1
    for i, c in enumerate(text):
        if ord(c) >= 0xC0 and c.isupper() and (text[i - 1] if i else before).islower():
            out += 1
        if ord(c) >= 0x100 and (own := script(c)) and own != "LATIN":
            near = [script(x) for x in (text[i - 1] if i else before, text[i + 1] if i < last else after) if x]
            out += 3 * sum(x not in ("", own) for x in near)
            out += (0.6 - cost(c) if cost(c) == 1.3 else 0) if own in near else 2.5 if own != "ARABIC" else 0
    return out


@cache
def _own_script(encoding: str) -> str:
    """The script of the high letters of an encoding, if it is not Latin."""
    names = [n for c in _table(encoding)[0][128:] if (n := script(c)) not in ("", "LATIN")]
    return max(set(names), key=names.count) if len(names) > 40 else ""


@cache
def _own_letters(encoding: str) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in _table(encoding)[0][128:] if script(c) == _own_script(encoding)) + "]")


def _decoded(stretch: str, back: dict[str, int]) -> str | None:
    try:
        return bytes(back[c] for c in stretch).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _single(stretch: str, back: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(begin, end) of the UTF-8 sequences of a stretch."""
    at = 0
    while at < len(stretch):
        b = back[stretch[at]]
        size = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        yield at, at + size
        at += size


def _line_layer(line: str, encoding: str) -> tuple[float, str]:
    """The drop of the cost and the line with one layer of the encoding taken off where that lowers the cost."""
    back, gain, out, at = _table(encoding)[1], 0.0, [], 0
    own, explained, all_parts = _own_script(encoding), 0, []
    found = list(_pattern(encoding).finditer(line))
    if own and found and (there := len(_own_letters(encoding).findall(line))):
        if 2 * sum(len(_own_letters(encoding).findall(m.group())) for m in found) <= there:
            return 0.0, line  # it is a line in that script
    for m in found:
        before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
        whole = _decoded(m.group(), back)
        drop = -1.0 if whole is None else _fit(m.group(), before, after) - _fit(whole, before, after)
        if drop > 0 or whole is not None and len(m.group()) < 5 and drop > -LEAST_GAIN:
            all_parts.append((m.start(), m.end(), whole, drop))
        else:  # some of a stretch may be text as it was written
            old = m.group()
            for a, b in _single(old, back):
                if (new := _decoded(old[a:b], back)) is not None and (a, b) != (0, len(old)):
                    x, y = old[a - 1] if a else before, old[b] if b < len(old) else after
                    if (drop := _fit(old[a:b], x, y) - _fit(new, x, y)) > 0:
                        all_parts.append((m.start() + a, m.start() + b, new, drop))
    sure = sum(drop for *_, drop in all_parts if drop > 0) > LEAST_GAIN
    for a, b, new, drop in all_parts:
        if drop > 0 or sure:  # what is no gain by itself goes with the rest of its line
            gain += drop
            explained += sum(script(c) == own for c in line[a:b]) if own else 0
            out += [line[at:a], new]
            at = b
    if own and gain and (there := sum(script(c) == own for c in line)) and 2 * explained <= there:
        return 0.0, line  # it is a line in that script
    return gain, "".join(out) + line[at:] if out else line


def _layer(text: str) -> str | None:
    """The text with one layer taken off where that lowers the cost, by the encoding that lowers it most."""
    best, most = None, 0.0
    runs = " ".join(set(_RUN.findall(text)))
    lines = text.split("\n")
    for encoding in LEGACY:
        if _pattern(encoding).search(runs):
            done = [_line_layer(line, encoding) if not line.isascii() else (0.0, line) for line in lines]
            if (gain := sum(g for g, _ in done)) > most:
                most, best = gain, "\n".join(new for _, new in done)
    return best


#: Letters of Latin words, and signs that stand in no word: box drawing, technical signs, mathematics. Fixed values.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIGNS = "─-◿⌀-⏿∀-⋿ⁿ₧ƒ√∙"
#: Places where text read under a wrong single-byte encoding gives itself away: words that mix scripts, signs inside words or at their
#: ends, a capital after a small letter, single letters that are no word, dashes and quotation marks that became letters.
_ODD = re.compile(
    "|".join(
        (
            rf"[{_L}][Ѐ-ԯ]|[Ѐ-ԯ][{_L}]",
            rf"[{_L}]{{2}}[Ͱ-Ͽ]|[{_L}][Ͱ-λν-Ͽ](?=[a-zà-öø-ÿ])|[Ͱ-λν-Ͽ](?=[a-zà-öø-ÿ]{{3}})",
            rf"[{_L}]{{2}}[{_SIGNS}]|[{_SIGNS}](?=[a-zà-öø-ÿ]{{3}})|(?<!\S)⌐(?=\s|$)|[\u2552-\u2593](?=[\dA-Za-z])",
            r"[a-zß-öø-ÿ][‚„†‡ˆ‰‹™›¡¢£¤¥¦¨ª«¯´¸º¼½¾¿•˜◊÷×](?=[a-zß-öø-ÿ])|[a-zß-öø-ÿ][‚ˆ‹¡¢¤¥¦¿˜◊÷](?![\w])",
            r"[a-zß-öø-ÿ][À-ÖØ-ÞŠŒŽŸ](?![A-ZÀ-ÖØ-Þ]{2})|\b[A-Z][À-ÖØ-Þ](?=[a-z])|[À-ÖØ-Þ]\d",
            r"[ìòùÌÒÙ][a-z]|(?<!\S)[ÆÙªº](?!\S)|[a-z][ìîû](?!\w)|[a-z][“”„](?=[a-z])",
            r"[A-Za-z][\u0620-\u064a\u066e-\u06d3]|[\u0620-\u064a\u066e-\u06d3][A-Za-z]",
        )
    )
)
#: Weaker evidence: small letters that misread umlauts become, which are usual in languages of central Europe, and single letters that
#: misread dashes become. Fixed values.
_WEAK = re.compile(r"[a-z][šž](?=[a-z])|(?<!\S)[ûñìîôò](?!\S)")
_CENTRAL = re.compile(r"[čřěůćđťňľĺŕČŘĚŮĆĐ]")
#: A Cyrillic letter before a number, in a line without Cyrillic words.
_NUMBERED = re.compile(r"(?<!\S)[Ѐ-ԯ](?=\d)")
_WALL = re.compile(r"[À-ÖØ-öø-ÿ]{4,}")
#: What no odd place is without: anything but ASCII and Arabic letters and signs, or Arabic letters beside Latin ones.
_ANY = re.compile(r"[^\x00-\x7f\u0600-\u06ff\s]|[A-Za-z][\u0600-\u06ff]|[\u0600-\u06ff][A-Za-z]")
_HIGH = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
_OTHER_WORDS = re.compile(r"[Ͱ-Ͽ]{4,}|[Ѐ-ԯ]{4,}")
_WHOLE_OTHER = re.compile(r"\W*(?:[Ͱ-Ͽ]{3,}|[Ѐ-ԯ]{3,})\W*")
#: Whole words in Cyrillic, and a capital after a small letter in them.
_CYRILLIC, _SMALL_CAPITAL = re.compile(r"[Ѐ-ӿ]{4,}"), re.compile(r"[а-я][А-Я]")


def _turn(text: str, wrong: str, right: str) -> str:
    back, chars = _table(wrong)[1], _table(right)[0]
    return _HIGH.sub(lambda m: chars[back[m.group()]] if m.group() in back else m.group(), text)


def _arabic_as_cyrillic(line: str) -> str | None:
    """The line if its whole words are Arabic that was read as Cyrillic: all are Arabic when turned, and capitals follow small letters."""
    found = _CYRILLIC.findall(line)
    if not found or 4 * sum(bool(_SMALL_CAPITAL.search(w)) for w in found) < len(found):
        return None
    turned = _turn("".join(found), *ARABIC_AS_CYRILLIC)
    return _turn(line, *ARABIC_AS_CYRILLIC) if all(0x600 <= ord(c) < 0x700 for c in turned) else None


def _oddness(text: str) -> float:
    weak = 0 if _CENTRAL.search(text) else 2 * len(_WEAK.findall(text))
    weak += 0 if _CYRILLIC.search(text) else 4 * len(_NUMBERED.findall(text))
    return total(text) + 4 * len(_ODD.findall(text)) + weak + 3 * sum(len(w) for w in _WALL.findall(text))


def _is_odd(text: str) -> bool:
    return bool(_ANY.search(text)) and bool(_ODD.search(text) or _WALL.search(text) or _WEAK.search(text) or _NUMBERED.search(text))


def _turn_words(line: str, wrong: str, right: str) -> str:
    """The line with its words turned, if that makes it less odd, but for whole words in another script than Latin; else with the words
    turned that become less odd by themselves. A word is what stands between blanks."""

    def turned(m: re.Match) -> str:
        return m.group() if _WHOLE_OTHER.fullmatch(m.group()) else _turn(m.group(), wrong, right)

    def better(m: re.Match) -> str:
        new = turned(m)
        return new if _oddness(f" {new} ") < _oddness(f" {m.group()} ") else m.group()

    if right == "cp1256" and not _WALL.search(line) or len(_OTHER_WORDS.findall(line)) > 1:
        return line
    whole = _WORD.sub(turned, line)
    return whole if _oddness(whole) < _oddness(line) else _WORD.sub(better, line)


def _swap(text: str) -> str | None:
    """The text with words of single-byte characters read under the right encoding, where they are odd and the cost drops."""
    lines = text.split("\n")
    if _SMALL_CAPITAL.search(text):
        turned = [new if (new := _arabic_as_cyrillic(x)) is not None else x for x in lines]
        if turned != lines:
            return "\n".join(turned)
    if not _is_odd(text):
        return None
    odd = [x for x in lines if not x.isascii() and _is_odd(x)]
    if not odd:
        return None
    base = sum(map(_oddness, odd))
    gains = {pair: base - sum(_oddness(_turn_words(x, *pair)) for x in odd) for pair in SWAPPED}
    best = max(gains, key=gains.get)
    if gains[best] < LEAST_GAIN:
        return None
    new = "\n".join(x if x.isascii() else _turn_words(x, *best) for x in lines)
    return new if new != text else None


#: What is left of sequences whose last byte was dropped or became a space. Fixed values.
_CUT_QUOTE, _CUT_SPACE = re.compile(r"â€(?![\x80-\xbfŒ-™])"), re.compile(r"(?<=[a-zà-ÿ0-9©®»”.])Â[ \xa0]|(?<![^\s])Â ")


def repair(text: str) -> tuple[str, int]:
    """The text with all layers taken off, and how many there were. Every layer makes the text shorter, so there is an end."""
    layers = 0
    # Arabic read as Cyrillic has pairs that look like UTF-8 by chance, so it comes before any layer
    if _SMALL_CAPITAL.search(text) and any(_arabic_as_cyrillic(x) is not None for x in text.split("\n")) and (new := _swap(text)) is not None:
        text, layers = new, 1
    while (new := _layer(text)) is not None:
        text, layers = new, layers + 1
    rest = _CUT_SPACE.sub(" ", _CUT_QUOTE.sub("”", text))
    if layers:
        rest = rest.replace("Ã ", "à ")
    if rest != text:
        text, layers = rest, max(layers, 1)
    if (new := _swap(text)) is not None:
        text, layers = new, layers + 1
    return text, layers


@cache
def _sequence_masks() -> tuple[np.ndarray, np.ndarray]:
    """For every code point a bit for each encoding under which it is the first byte of a UTF-8 sequence, and a further one."""
    lead, more = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)
    for i, encoding in enumerate(LEGACY):
        for b, c in enumerate(_table(encoding)[0]):
            lead[ord(c)] |= (1 << i) if 0xC2 <= b <= 0xF4 else 0
            more[ord(c)] |= (1 << i) if 0x80 <= b <= 0xBF else 0
    return lead, more


@cache
def _no_gain() -> np.ndarray:
    """Sorted pairs (first << 21 | second) of usual characters that are a sequence by chance and never cheaper when decoded."""
    out = []
    for a in range(0x80, 0x2200):
        lead, more = _sequence_masks()
        if not lead[a]:
            continue
        for b in np.flatnonzero((more[:0x2600] & lead[a]) > 0):
            pair = chr(a) + chr(int(b))
            drops = [max(total(pair), _fit(pair, "", "")) - min(total(new), _fit(new, "", ""), 0.6 if cost(new[0]) == 1.3 else 9) for e in LEGACY if _pattern(e).fullmatch(pair) and (new := _decoded(pair, _table(e)[1])) is not None]
            three = any(0xE0 <= _table(e)[1].get(chr(a), 0) <= 0xF4 for e in LEGACY if (lead[a] >> LEGACY.index(e)) & 1)
            if not three and (not drops or max(drops) <= 0):
                out.append(a << 21 | int(b))
    return np.array(sorted(out), np.int64)


@cache
def _arabic() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in _table("cp1256")[0][128:]:
        out[ord(c)] = script(c) == "ARABIC"
    return out


def _mostly_explained(points: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of pairs that are sequences under cp1256 alone, those on lines whose Arabic letters such sequences may hold for the most part."""
    if not len(at):
        return at
    edge = points == 10
    edge[begins[begins < len(points)]] = True
    line = np.cumsum(edge)
    letter = _arabic()[points]
    four = letter[np.minimum(at[:, None] + np.arange(4), len(points) - 1)].sum(axis=1)  # a sequence has four at most
    there = np.bincount(line[letter], minlength=line[-1] + 1)
    held = np.bincount(line[at], four, minlength=line[-1] + 1)
    return at[2 * held[line[at]] >= there[line[at]]]


LATIN, SMALL, CAPITAL, HIGH_CAPITAL, OTHER, ODD_SIGN, HIGH, DIGIT, SPACE, ARABIC, WEAK, CYRILLIC, SINGLE, BEYOND, GREEK, QUOTE = (1 << i for i in range(16))


@cache
def _classes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint16)
    t[0x80:] |= HIGH
    for kind, pattern in ((LATIN, f"[{_L}]"), (SMALL, "[a-zß-öø-ÿ]"), (CAPITAL, "[A-Z]"), (HIGH_CAPITAL, "[À-ÖØ-ÞŠŒŽŸ]"), (OTHER, f"[Ͱ-ԯ{_SIGNS}]"), (ODD_SIGN, "[‚„†‡ˆ‰‹™›¡¢£¤¥¦¨ª«¯´¸º¼½¾¿•˜◊÷×ìîû]"), (QUOTE, "[“”„]"), (DIGIT, r"\d"), (SPACE, r"\s"), (ARABIC, "[\u0620-\u06d3\u06ee-\u06ff]"), (WEAK, "[šž]"), (CYRILLIC, "[Ѐ-ӿ]"), (GREEK, "[Ͱ-Ͽ]"), (SINGLE, "[ûñìîôÆòÙªº⌐]")):
        found = re.compile(pattern)
        for i in range(0x3000):
            if found.match(chr(i)):
                t[i] |= kind
    t[0x530:0x600] |= BEYOND
    t[0x700:0x2000] |= BEYOND
    t[0x2C00:] |= BEYOND
    for c in "ìòùÌÒÙ":
        t[ord(c)] |= ODD_SIGN
    return t


def suspects(texts: pa.Array) -> np.ndarray:
    """Indices of the texts that may be garbled, from pairs of neighbouring characters; it lets too many through, none too few.

    A pair is a sequence of UTF-8 under some encoding that may be cheaper when decoded, or the beginning of an odd place.
    """
    points, begins = code_points(texts)
    if not len(points):
        return np.zeros(0, np.int64)
    c = _classes()[points]
    # a position before each character and one after the last, so that ends of texts count as blanks
    edge = np.zeros(len(points) + 1, bool)
    edge[begins[begins <= len(points)]] = True
    p, q = c[:-1], c[1:]
    inside = ~edge[1:-1]
    at = np.flatnonzero((p & HIGH != 0) & (q & HIGH != 0) & inside)
    hit = np.zeros(len(c), bool)
    lead, more = _sequence_masks()
    both = lead[points[at]] & more[points[at + 1]]
    at, both = at[both != 0], both[both != 0]
    if len(at):
        known = _no_gain()
        pair = points[at].astype(np.int64) << 21 | points[at + 1]
        place = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        at, both = at[known[place] != pair], both[known[place] != pair]
        arabic = both == 1 << LEGACY.index("cp1256")
        hit[at[~arabic]] = True
        hit[_mostly_explained(points, begins, at[arabic])] = True
    pairs = ((LATIN, OTHER), (OTHER, LATIN | DIGIT), (SMALL, ODD_SIGN | HIGH_CAPITAL), (ODD_SIGN, SMALL), (HIGH_CAPITAL, DIGIT), (LATIN, ARABIC), (ARABIC, LATIN), (CYRILLIC, GREEK), (GREEK, CYRILLIC), (SMALL, WEAK), (CYRILLIC, CYRILLIC), (ARABIC, OTHER | BEYOND), (OTHER | BEYOND, ARABIC), (BEYOND, OTHER | LATIN), (OTHER | LATIN, BEYOND))
    for a, b in pairs:
        hit[:-1] |= (p & a != 0) & (q & b != 0) & inside
    blank = (c & SPACE != 0) | (c & HIGH == 0) & (c & (SMALL | CAPITAL | DIGIT) == 0)
    before, after = np.ones(len(c), bool), np.ones(len(c), bool)
    before[1:] = blank[:-1] | edge[1:-1]
    after[:-1] = blank[1:] | edge[1:-1]
    hit |= (c & SINGLE != 0) & before & after
    hit |= (c & (ODD_SIGN | OTHER) != 0) & after & ~before  # at the end of a word
    if len(c) > 2:
        hit[:-2] |= (c[:-2] & (SMALL | CAPITAL) != 0) & (c[1:-1] & (QUOTE | HIGH_CAPITAL) != 0) & (c[2:] & SMALL != 0)
    # four accented letters in a row
    accented = (points >= 0xC0) & (points < 0x100)
    if len(c) > 3:
        hit[:-3] |= accented[:-3] & accented[1:-2] & accented[2:-1] & accented[3:]
    # what is left of cut sequences
    hit |= (points == 0xC2) & after
    hit[:-1] |= (points[:-1] == 0xC2) & (points[1:] == 0xA0) | (points[:-1] == 0xE2) & (points[1:] == 0x20AC)
    hit |= points == 0xFFFD
    return np.unique(np.searchsorted(begins, np.flatnonzero(hit), side="right") - 1)


def repaired(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, text, layers, lost of every row that was garbled: its repaired text, the layers taken off, characters lost for good.

    Rows with null, empty or clean text give no row; repeated rows give a row each; other columns are not read.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {text} string, layers int, lost int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, layers, lost = [], [], [], []
            for i, t in _suspect_texts(b.column(text)):
                new, n = repair(t)
                gone = t.count(REPLACEMENT)
                if n or gone:
                    at.append(i), out.append(new), layers.append(n), lost.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(layers, pa.int32()), pa.array(lost, pa.int32())], [key, text, "layers", "lost"])

    # text of ASCII alone, as many bytes as characters, was never garbled
    return pages.select(key, text).filter(F.octet_length(text) != F.length(text)).mapInArrow(run, schema)


def _suspect_texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    for at in range(0, len(column), 4000):
        part = column.slice(at, 4000)
        for i in suspects(part):
            yield at + int(i), part[int(i)].as_py()


def repair_column(column: pa.Array) -> pa.Array:
    """The column with garbled texts repaired; nulls stay."""
    new = {i: r for i, t in _suspect_texts(column) if (r := repair(t)[0]) != t}
    if not new:
        return column
    out = column.to_pylist()
    for i, t in new.items():
        out[i] = t
    return pa.array(out, pa.string())


def repair_all(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, text of every row, garbled ones repaired; null stays null."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {text} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), repair_column(b.column(text))], [key, text])

    return pages.select(key, text).mapInArrow(run, schema)
