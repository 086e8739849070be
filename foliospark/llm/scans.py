"""Noise in text from scanned pages (problem 3): furniture, words cut at line ends, misread characters.

Over all pages the words are counted; frequent words form the vocabulary. Skip-gram vectors come from all scanned pages, for the words of
the vocabulary and for the rare words that plausible glyph edits lead from to one of them: the skip-gram counts of a word (its neighbours
within two places) projected to a few dimensions by random signs, which are sums and so are built in parallel. A rare word is linked to
the frequent word whose vector is nearest to its own, if that is near enough; what is first made by joining or closing up is judged by its
own neighbours on the page. Then running headers and page numbers go, cut words are joined, lines are reflowed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import mix, words
from foliospark.session import materialise

SCANNED = ("ocr", "urdu_ocr", "unknown")
#: A word is frequent if it stands in this share of the pages, and in so many at least. The share bounds the vocabulary: with w distinct
#: words a page there are at most w / SHARE frequent ones.
SHARE, LEAST = 1e-3, 3
DIM, WINDOW = 32, 2
#: What a glyph or pair is read as, and what it stands for. Fixed values.
GLYPHS = (("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("vv", "w"), ("c", "e"), ("e", "c"), ("ii", "u"), ("ii", "n"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("í", "i"), ("ì", "i"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("ri", "n"), ("in", "m"), ("iii", "m"), ("nn", "m"), ("q", "g"), ("y", "v"), ("a", "o"), ("o", "a"))
HYPHENS = "-\xad¬‐‑"

# -- header lines ------------------------------------------------------------------------------------------------------------------


def _letters(line: Column) -> Column:
    return F.lower(F.upper(F.regexp_replace(line, r"\P{L}+", "")))


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(line: str) -> str:
    key = _NO_LETTERS.sub("", line)
    return (key if key.isalpha() else "".join(c for c in key if c.isalpha())).upper().lower()


#: A page number beside a header. Fixed value.
_TAIL = r"(?:\s{2,}|\s*\.{3,}\s*|\s*\|\s*|\s+[-–—]\s+)(?:\p{L}{1,2}-|(?i:page|pg|p)\.? ?)?\d{1,5}\s*$"

#: What may stand beside a header, and a header after the name of an author, who need not be the one in file_meta. Fixed values.
_BESIDE = r"(?:\s*\|\s*|\s+)[^\W\d_]{1,12}-?\.?\s*\d+\s*$|^\s*(?:p|pg|page)\.?\s*\d+\s+"
_NAMED = r"^(?:[A-ZÀ-ÖØ-Þ][\w'’.-]*\s+){1,3}[A-ZÀ-ÖØ-Þ][\w'’.-]*\s*:\s*(\S.+)$"
#: Letters that an author's name or a page number may add to a header, at most.
BESIDE_LETTERS = 60


def headers(pages: DataFrame, meta: DataFrame | None = None, least_letters: int = 8) -> DataFrame:
    """file_hash, key (letters): the running headers of each file that has scanned pages.

    The title of the file counts, alone or with its author, and so do short lines at the top or bottom of at least LEAST pages of the
    file, scanned or not; two pages are enough if the line holds a number apart or they are as many as a tenth of the scanned pages.
    """
    whole = pages.filter(F.col("text").isNotNull() & F.col("file_hash").isNotNull()).select("file_hash", "page_number", "source_type", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    lines = whole.select("file_hash", "page_number", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0).alias("lines")).filter(F.size("lines") > 1)
    ends = lines.select("file_hash", "page_number", F.explode_outer(F.array_distinct(F.concat(F.slice("lines", 1, 2), F.slice("lines", -2, 2)))).alias("line"))
    keyed = ends.filter((F.length("line") <= 90) & ~F.col("line").rlike(r"[.,;:!?۔،]\s*$")).select("file_hash", "page_number", _letters(F.col("line")).alias("key"), F.when(F.col("line").rlike(r"\d\s*$"), F.col("line").rlike(_TAIL)).otherwise(F.lit(False)).alias("numbered")).filter(F.length("key") >= least_letters)
    counted = keyed.groupBy("file_hash", "key").agg(F.count_distinct("page_number").alias("pages"), F.sum(F.col("numbered").cast("int")).alias("numbered"))
    sizes = whole.filter(F.col("source_type").isin(*SCANNED)).groupBy("file_hash").agg(F.count_distinct("page_number").alias("scans"))
    often = counted.join(sizes, "file_hash").filter((F.col("pages") >= LEAST) | ((F.col("pages") == 2) & ((F.col("numbered") > 0) | (F.col("pages") >= 0.1 * F.col("scans"))))).select("file_hash", "key")
    if meta is not None:
        titled = meta.filter(F.col("file_hash").isNotNull() & F.col("title").rlike(r"\d|\s"))
        forms = [F.col("title")]
        if "author" in meta.columns:
            forms += [F.concat("author", "title"), F.concat("title", "author")]
        titles = titled.filter(F.length(_letters(F.col("title"))) >= least_letters).select("file_hash", F.explode(F.array(*map(_letters, forms))).alias("key")).filter(F.col("key").isNotNull())
        often = often.unionByName(titles)
    return often.distinct()


def page_headers(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """file (hash of file_hash), page_id, key (letters): the headers of the file that are among the lines of the page.

    Lines meet headers in a join, so nothing grows with a file.
    """
    longest = known.agg(F.max(F.length("key"))).first()[0] or 0
    there = scanned.filter(F.col("text").isNotNull() & F.col("file_hash").isNotNull())
    lines = there.select("file_hash", "page_id", F.explode_outer(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1)).alias("line"))
    # a header has no more letters than the longest one that is known, and what may stand beside it
    short = lines.withColumn("key", _letters(F.col("line"))).filter(F.length("key").between(1, longest + BESIDE_LETTERS))
    beside = F.when(F.col("line").rlike(r"\d"), _letters(F.regexp_replace("line", f"(?U){_BESIDE}", "")))
    named = F.when(F.contains("line", F.lit(":")), _letters(F.regexp_extract("line", rf"(?U)^\s*{_NAMED[1:]}", 1)))
    forms = F.array_distinct(F.array_compact(F.array("key", beside, named)))
    # what travels of a line is a hash; the text of the key comes from the headers
    keyed = short.select("file_hash", "page_id", F.explode_outer(forms).alias("key")).filter(F.length("key") > 0).select(F.xxhash64("file_hash", "key").alias("h"), F.xxhash64("file_hash").alias("file"), "page_id")
    return keyed.join(known.select(F.xxhash64("file_hash", "key").alias("h"), "key"), "h").select("file", "page_id", "key")


# -- vocabulary and vectors --------------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, pages, scans: in how many pages, and in how many scanned ones, each word stands, batch by batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4000):
            part = batch.slice(i, 4000)
            w = words(part.column("text"))
            scan = np.asarray(part.column("scan").to_numpy(zero_copy_only=False), np.int64)
            pair = np.unique(mix(w.hash) ^ mix(w.row.astype(np.uint64)), return_index=True)[1]  # one of each word and page
            hashed, at, back, count = np.unique(w.hash[pair], return_index=True, return_inverse=True, return_counts=True)
            scans = np.bincount(back, scan[w.row[pair]], len(hashed)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w.text(k) for k in pair[at]], pa.string()), pa.array(count), pa.array(scans)], ["word", "pages", "scans"])


def vocabulary(pages: DataFrame) -> dict[str, int]:
    """The frequent words of all pages and in how many pages each stands; bounded by SHARE.

    A form that scans have ten times as often, page for page, as other pages is damage that happens to be frequent, not a word.
    """
    texts = pages.select("text", F.coalesce(F.col("source_type").isin(*SCANNED), F.lit(False)).cast("int").alias("scan")).filter(F.col("text").isNotNull())
    size = texts.agg(F.count("*").alias("n"), F.sum("scan").alias("scans")).first()
    total, scanned = size["n"], size["scans"] or 0
    counts = texts.mapInArrow(_word_counts, "word string, pages bigint, scans bigint").groupBy("word").agg(F.sum("pages").alias("pages"), F.sum("scans").alias("scans"))
    frequent = counts.filter(F.col("pages") >= max(LEAST, SHARE * total))
    if scanned < total:
        frequent = frequent.filter((F.col("pages") - F.col("scans")) * (10 * max(scanned, 1)) >= F.col("scans") * (total - scanned))
    else:
        frequent = frequent.filter(~F.col("word").rlike(r"\p{L}\d+\p{L}"))
    return {r["word"]: r["pages"] for r in frequent.select("word", "pages").collect()}


def _signs(hashed: np.ndarray) -> np.ndarray:
    return (((mix(hashed)[:, None] >> np.arange(DIM, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1)


def _hashes(vocab: list[str]) -> np.ndarray:
    known = words(pa.array(vocab, pa.string()))
    whole = np.zeros(len(vocab), np.uint64)
    whole[known.row] = known.hash
    return whole


def contexts(pages: DataFrame, vocab: list[str], counts: list[int]) -> DataFrame:
    """What every scanned page says of words, batch by batch: word, place in the vocabulary (or null for a rare word with candidates),
    v (sum of the signs of its neighbours), n (how many), and for rare words the pages they stand on (file_hash, page_id)."""
    sent = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocab, counts, np.zeros((len(vocab), DIM), np.float32)))  # bounded by SHARE

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers(sent)
        order = np.argsort(reader.hashes)
        hashes, signs = reader.hashes[order], reader.signs[order]
        acc, seen = np.zeros((len(hashes), DIM), np.float32), np.zeros(len(hashes), np.int64)
        at_type = None
        for batch in batches:
            at_type = batch.schema.field("page_id").type
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                w = words(part.column("text"))
                if not len(hashes) or not len(w.hash):
                    continue
                at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                ident = np.where(hashes[at] == w.hash, at, -1)
                sure = np.concatenate((signs, np.zeros((1, DIM), np.float32)))[ident]
                near, number = np.zeros((len(ident), DIM), np.float32), np.zeros(len(ident), np.int64)
                for d in range(1, WINDOW + 1):
                    same = w.row[d:] == w.row[:-d]
                    near[:-d] += sure[d:] * same[:, None]
                    near[d:] += sure[:-d] * same[:, None]
                    number[:-d] += same & (ident[d:] >= 0)
                    number[d:] += same & (ident[:-d] >= 0)
                known = np.flatnonzero(ident >= 0)
                known = known[np.argsort(ident[known], kind="stable")]
                begins = np.flatnonzero(np.diff(ident[known], prepend=-1))
                if len(known):
                    acc[ident[known[begins]]] += np.add.reduceat(near[known], begins, axis=0)
                    seen[ident[known[begins]]] += np.add.reduceat(number[known], begins)
                rare = np.flatnonzero(ident < 0)
                kinds, first, back = np.unique(w.hash[rare], return_index=True, return_inverse=True)
                texts = [w.text(rare[f]) for f in first]
                keep = np.array([not t.isdigit() and bool(reader.candidates(t)) for t in texts], bool)
                if not keep.any():
                    continue
                order_of = np.argsort(back, kind="stable")
                begins = np.flatnonzero(np.diff(back[order_of], prepend=-1))
                v, n = np.add.reduceat(near[rare[order_of]], begins, axis=0)[keep], np.add.reduceat(number[rare[order_of]], begins)[keep]
                pages_of = [np.unique(w.row[rare[x]]) for x, k in zip(np.split(order_of, begins[1:]), keep, strict=True) if k]
                flat = pa.array(np.concatenate(pages_of))
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in pages_of]))), pa.int32())
                there = pa.StructArray.from_arrays([part.column("file_hash").take(flat), part.column("page_id").take(flat)], ["file_hash", "page_id"])
                yield pa.RecordBatch.from_arrays([pa.array([t for t, k in zip(texts, keep, strict=True) if k]), pa.nulls(len(v), pa.int64()), _vector_lists(v), pa.array(n), pa.ListArray.from_arrays(ends, there)], ["word", "place", "v", "n", "pages"])
        used = np.flatnonzero(seen > 0)
        if len(used):
            kind = pa.list_(pa.struct([("file_hash", pa.string()), ("page_id", at_type)]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array(order[used]), _vector_lists(acc[used]), pa.array(seen[used]), pa.nulls(len(used), kind)], ["word", "place", "v", "n", "pages"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scanned = pages.filter(F.col("source_type").isin(*SCANNED) & F.col("text").isNotNull()).select(F.col("file_hash").cast("string").alias("file_hash"), "page_id", "text")
    return scanned.mapInArrow(sums, f"word string, place bigint, v array<float>, n bigint, pages array<struct<file_hash: string, page_id: {kind}>>")


def _vector_lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * DIM, pa.int32()), pa.array(np.ascontiguousarray(v, np.float32).ravel()))


def _summed(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*[F.sum(F.col("v")[i]).cast("float") for i in range(DIM)]).alias("v"), F.sum("n").alias("n"))


def vectors(said: DataFrame, size: int) -> np.ndarray:
    """Skip-gram vectors (words x DIM, unit length) of the vocabulary."""
    out = np.zeros((size, DIM), np.float32)
    got = _summed(said.filter(F.col("place").isNotNull()), "place").toArrow()  # bounded by the vocabulary
    out[got.column("place").to_numpy()] = np.asarray(got.column("v").combine_chunks().flatten()).reshape(-1, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def links(said: DataFrame, sent) -> DataFrame:
    """word, target, near (cosine of the vectors) of each rare word: the candidate whose vector is nearest to its own."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers(sent)
        for b in batches:
            rare = b.column("word").to_pylist()
            v = np.asarray(b.column("v").flatten()).reshape(-1, DIM)
            best = [reader.nearest(reader.candidates(w), x) for w, x in zip(rare, v, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.float32())], ["word", "target", "near"])

    return _summed(said.filter(F.col("word").isNotNull()), "word").select("word", "v").mapInArrow(link, "word string, target string, near float")


# -- one page ----------------------------------------------------------------------------------------------------------------------

_NUMBER_LINE = re.compile(r"(?i)^\W*(?:(?:page|pg|p|seite|s|página|pagina|pág|صفحہ|صفحة|ص)\.?\s*)?(\d{1,6})(?:\s*(?:of|/|von|de|sur|سے|من)\s*\d{1,6})?(?:\s*\|\s*p\s*a\s*g\s*e)?\W*$")
_MARKED = re.compile(r"(?i)page|pg\.?\s|p\.\s*\d|seite|página|pág|صفح|[-–—\[(|/]\s*\d|\d\s*[-–—\])|/]")
_ROMAN = re.compile(r"^[-–—\[( ]*([ivxlc]{1,7})[-–—\]) ]*$")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
_MARKS = re.compile(r"(?<=[؀-ۿ])[\^~|&](?=[؀-ۿ])|(?<=[a-zà-ÿ])[\^~&](?=[a-zà-ÿ])")
_JOIN = re.compile(rf"([^\W_|]+(?:[|!0-9]+[^\W_]*)*)[{HYPHENS}][ \t]*\n[ \t]*([^\W_][\w|!]*)")
_TOKEN = re.compile(r"[^\W_](?:[\w|!]*[^\W_|!])?|[|0-9][a-z][\w|!]*")
_MIXED = re.compile(r"[a-zà-ÿA-Z][0-9|!]+[a-zà-ÿ]|^[0-9|!][a-zà-ÿ]{3,}|[a-zà-ÿ]{3,}[0-9|!]$")


def roman(text: str) -> int:
    values = [_ROMAN_VALUES[c] for c in text]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))


def is_page_number(line: str, page: int | None) -> bool:
    line = line.strip()
    if not line:
        return False
    if m := _NUMBER_LINE.match(line):
        return bool(_MARKED.search(line)) or (page is not None and int(m.group(1)) == page)
    m = _ROMAN.match(line)
    return bool(m) and page is not None and roman(m.group(1)) == page


_NUMBERED = re.compile(r"^(?:(?P<a>\d{1,6})\s{2,}\S.{6,90}|\S.{6,90}?(?:\s{2,}|\s*\.{4,}\s*)(?P<b>\d{1,6}))$")


_ISSUE = re.compile(r"^\S.{6,90}?\s*\|\s*[^\W\d_]{2,12}-\d{1,4}$")


def is_numbered_header(line: str, page: int | None) -> bool:
    """A header with the number of its page, or that of an issue after a bar, set apart from it."""
    if _ISSUE.match(line):
        return True
    m = _NUMBERED.match(line)
    return bool(m) and page is not None and int(m["a"] or m["b"]) == page


#: How near the vector of a rare word, or of its neighbours on a page, must be to that of the word it is taken for: a letter among digits
#: or signs is damage as such; letters for letters need the vectors' word for it, and a word that is not far more frequent needs more.
NEAR_MIXED, NEAR_LETTERS, NEAR_NAMES = -0.5, 0.05, 0.3
#: Edits that scans make by far the most often. Fixed values.
USUAL = (("c", "e"), ("rn", "m"), ("li", "h"), ("l", "i"), ("i", "l"))


_DIGIT, _BESIDE_LINE, _NAMED_LINE = re.compile(r"\d"), re.compile(_BESIDE), re.compile(_NAMED)


class Reader:
    """The repair of single pages with one vocabulary and its vectors."""

    def __init__(self, vocab: list[str], counts: list[int], vecs: np.ndarray):
        self.place = {w: i for i, w in enumerate(vocab)}
        self.count = counts
        self.most = max(counts, default=1)
        self.vecs = vecs
        self.hashes = _hashes(vocab)
        self.signs = _signs(self.hashes)
        self.heads = {w[:i] for w in vocab for i in range(len(w) + 1)}
        self.edits: dict[str, list[tuple[str, str]]] = {}
        for bad, good in GLYPHS:
            self.edits.setdefault(bad[0], []).append((bad, good))
        self.candidates = lru_cache(1 << 17)(self._candidates)

    def _walk(self, word: str, edits: int, mixed: bool) -> set[str]:
        """Words of the vocabulary that so many glyph edits lead to, along the beginnings of its words. Of two edits in letters one at least
        is a usual one."""
        out, todo = set(), [(0, "", 0, False)]
        while todo:
            at, head, used, usual = todo.pop()
            if at == len(word):
                if used and head in self.place and (mixed or used < 2 or usual):
                    out.add(head)
                continue
            if head + word[at] in self.heads:
                todo.append((at + 1, head + word[at], used, usual))
            if used < edits:
                for bad, good in self.edits.get(word[at], ()):
                    if word.startswith(bad, at) and head + good in self.heads:
                        todo.append((at + len(bad), head + good, used + 1, usual or (bad, good) in USUAL))
        return out

    def _candidates(self, word: str) -> tuple[str, ...]:
        """Frequent words that the fewest glyph edits lead to from a rare word: one, or two in a long one; a digit or sign each takes one more."""
        low = word.lower()
        mixed = bool(_MIXED.search(low))
        if len(low) < 3 or (not mixed and len(low) < 4):
            return ()
        most = sum(not c.isalpha() for c in low) + 1 if mixed else 2 if len(low) >= 8 and low == word else 1
        for edits in range(1, most + 1):
            if found := self._walk(low, edits, mixed):
                return tuple(sorted(found, key=lambda y: (-self.count[self.place[y]], y)))
        return ()

    def nearest(self, options: tuple[str, ...], v: np.ndarray) -> tuple[str | None, float]:
        """The option whose vector is nearest to v, and the cosine; without known neighbours the most frequent one, just near enough."""
        if not options or not v.any():
            return (options[0] if options else None), NEAR_LETTERS
        near = self.vecs[[self.place[o] for o in options]] @ (v / max(float(np.linalg.norm(v)), 1e-9))
        k = int(np.argmax(near))
        return options[k], float(near[k])

    def correct(self, word: str, around: list[str], known: dict | None = None) -> str | None:
        """The frequent word that a rare word was misread from, or None."""
        low = word.lower()
        if low in self.place:
            return None
        if known and low in known:
            target, near = known[low]
        else:
            context = [self.place[a] for a in around if a in self.place]
            target, near = self.nearest(self.candidates(word), self.signs[context].sum(axis=0) if context else np.zeros(DIM, np.float32))
        if target is None:
            return None
        if _MIXED.search(word):
            return target if near >= NEAR_MIXED else None
        # capitalised words may be names of their own, so only by far more frequent words count, or those in the very same places
        bar = 4 if word[:1].isupper() else 1
        return target if near >= (NEAR_LETTERS if self.count[self.place[target]] >= bar * max(LEAST, 2e-3 * self.most) else NEAR_NAMES) else None

    def read(self, text: str, page: int | None, headers: frozenset[str], known: dict | None = None) -> tuple[str, set[str]]:
        """The page as paragraphs, and the kinds of damage found; known holds what its rare words are linked to."""
        kinds: set[str] = set()
        kept = []
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for line in lines:
            bare = line.strip()
            if bare and (is_page_number(bare, page) or self.is_header(bare, headers) or is_numbered_header(bare, page)):
                kinds.add("furniture")
            else:
                kept.append(line)
        text = "\n".join(kept)
        if any(c in text for c in HYPHENS):
            text = _JOIN.sub(lambda m: self.joined(m, kinds), text)
        new = _MARKS.sub("", text)
        if new != text:
            kinds.add("glyph")
            text = new
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self.closed(m, kinds), text)
        text = self.corrected(text, kinds, known)
        paragraphs = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", text)]
        return "\n\n".join(p for p in paragraphs if p), kinds

    def is_header(self, line: str, headers: frozenset[str]) -> bool:
        if not headers:
            return False
        if letters(line) in headers:
            return True
        if _DIGIT.search(line) and (short := _BESIDE_LINE.sub("", line)) != line and letters(short) in headers:
            return True
        m = _NAMED_LINE.match(line) if ":" in line else None
        return bool(m) and letters(m.group(1)) in headers

    def joined(self, m: re.Match, kinds: set[str]) -> str:
        left, right = m.group(1), m.group(2)
        whole = (left + right).lower()
        if whole in self.place or self.candidates(whole):
            kinds.add("hyphen")
            return left + right
        if right[:1].isupper() or right[:1].isdigit() and left[-1:].isdigit():
            return f"{left}-{right}"
        if right.lower() in self.place and left.lower() in self.place and min(self.count[self.place[right.lower()]], self.count[self.place[left.lower()]]) > 2 * LEAST:
            return f"{left}-{right}"  # a compound of two words
        kinds.add("hyphen")
        return left + right

    def closed(self, m: re.Match, kinds: set[str]) -> str:
        word = m.group().replace(" ", "")
        if word.lower() in self.place or len(word) >= 5 or self.candidates(word):
            kinds.add("glyph")
            return word
        return m.group()

    def corrected(self, text: str, kinds: set[str], known: dict | None = None) -> str:
        place = self.place
        rare = {w for w in _TOKEN.findall(text) if w.lower() not in place and not w.isdigit()}
        rare = {w for w in rare if _MIXED.search(w) or known and w.lower() in known or self.candidates(w)}
        if not rare:
            return text
        found = list(_TOKEN.finditer(text))
        place_of = {m.start(): i for i, m in enumerate(found)}

        def fix(m: re.Match) -> str:
            w = m.group()
            if w not in rare:
                return w
            i = place_of[m.start()]
            near = [x.group().lower() for x in found[max(0, i - WINDOW) : i] + found[i + 1 : i + 1 + WINDOW]]
            new = self.correct(w, near, known)
            if new is None:
                if not re.search(r"[a-zà-ÿ][0-9|!][a-zà-ÿ]", w):
                    return w
                kinds.add("glyph")  # a letter is a digit here, of a word that is not known
                return re.sub(r"(?<=[a-zà-ÿ])[01|5](?=[a-zà-ÿ])", lambda x: {"0": "o", "1": "i", "|": "l", "5": "s"}[x.group()], w)
            kinds.add("glyph")
            return new.upper() if w.isupper() and len(w) > 1 else new.capitalize() if w[0].isupper() or w[0] in "0159|" and new[0].isupper() else new

        return _TOKEN.sub(fix, text)


def _readers(sent) -> Reader:
    """The reader of a broadcast, built once by each Python worker."""
    name, vocab, counts, vecs = sent.value
    if (there := getattr(_readers, "last", None)) is None or there[0] != name:
        _readers.last = there = (name, Reader(vocab, counts, vecs))
    return there[1]


def repaired(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """page_id, text, kinds of every scanned page: continuous paragraphs, and the kinds of damage that were repaired.

    Null texts give null and no kinds; an empty table gives no rows; a page without file hash has no headers. Repeated rows stay.
    """
    spark = pages.sparkSession
    counts = vocabulary(pages)
    vocab = sorted(counts)
    said = materialise(contexts(pages, vocab, [counts[w] for w in vocab]), "contexts")
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, vocab, [counts[w] for w in vocab], vectors(said, len(vocab))))  # bounded by SHARE
    scanned = pages.filter(F.col("source_type").isin(*SCANNED)).select("page_id", "file_hash", "page_number", "text")
    linked = said.filter(F.col("word").isNotNull()).select("word", F.explode("pages").alias("p")).join(links(said, sent), "word").select(F.xxhash64("p.file_hash").alias("file"), "p.page_id", F.lit(None).cast("string").alias("key"), F.struct("word", "target", "near").alias("link"))
    lines = page_headers(scanned, materialise(headers(pages, meta), "headers")).select("file", "page_id", "key", F.lit(None).cast("struct<word: string, target: string, near: float>").alias("link"))
    own = lines.unionByName(linked).groupBy(F.col("file").alias("of_file"), F.col("page_id").alias("of_page")).agg(F.collect_set("key").alias("headers"), F.collect_set("link").alias("links"))
    rows = scanned.join(own, (F.xxhash64("file_hash") == F.col("of_file")) & F.col("page_id").eqNullSafe(F.col("of_page")), "left").select("page_id", "page_number", "text", "headers", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers(sent)
        for b in batches:
            texts, kinds = [], []
            for t, n, h, k in zip(*(b.column(c).to_pylist() for c in ("text", "page_number", "headers", "links")), strict=True):
                new, found = (None, set()) if t is None else reader.read(t, n, frozenset(h or ()), {x["word"]: (x["target"], x["near"]) for x in k or ()})
                texts.append(new), kinds.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["page_id", "text", "kinds"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, kinds array<string>")


def found(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """page_id, kind: one row for each kind of damage on a scanned page."""
    return repaired(pages, meta).select("page_id", F.explode("kinds").alias("kind")).distinct()
