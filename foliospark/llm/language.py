"""Languages of pages and of their stretches (problem 6).

A linear-chain conditional random field labels every word: hashed affix, character n-gram and lexicon features give its scores, learned
transitions link neighbours, and forward-backward gives the probabilities of each word's labels. It is trained here on a bounded sample of
labelled pages in two rounds: the first trusts the page labels; its own labels, on pages where it agrees with the label, then give word
labels, code switches included, for the second. Runs of a language that are too short join their neighbours.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.encoding_repair import repair_column
from foliospark.llm.words import Words, letter_mask, words

LANGUAGES = ("en", "de", "fr", "es", "pt", "ur", "ar")
#: Spellings of the languages besides their codes. Fixed values.
SPELLINGS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "español": "es", "por": "pt", "portuguese": "pt", "português": "pt", "urd": "ur", "urdu": "ur", "اردو": "ur", "ara": "ar", "arabic": "ar", "العربية": "ar",
}
#: Labelled pages of each language that the model is trained on, at most, and characters of such a page: longer ones are not drawn, which
#: bounds what comes to the driver.
PER_LANGUAGE, TRAIN_CHARS = 300, 20_000
BUCKETS = 1 << 16
#: Step of the gradient method: a word has some 25 features, which all move at once.
RATE = 0.05
#: A stretch has so many letters at least.
LEAST_LETTERS = 60


def language_code(label: Column) -> Column:
    """The code of a language label in any spelling, or null."""
    head = F.lower(F.trim(F.regexp_replace(label, "[-_].*$", "")))
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.when(head.isin(*LANGUAGES), head).otherwise(F.try_element_at(known, head))


def features(word: str) -> list[int]:
    """Buckets of the affix, n-gram, lexicon and script features of a lower-case word."""
    w = f"<{word}>"
    names = {f"w{word}", f"s{ord(word[0]) >> 7}"} if word else {"e"}
    names |= {f"p{word[:n]}" for n in range(1, 5)} | {f"x{word[-n:]}" for n in range(1, 5)}
    names |= {f"g{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)}
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in names]


def _steps(lengths: np.ndarray) -> np.ndarray:
    """For sequences in descending order of length: how many are at least t + 1 long."""
    return np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")


#: Steps between rescalings of forward and backward values, which keeps them in the range of double precision.
RESCALE = 4


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words, sequences, labels) and, if asked for, expected transitions.

    scores (words, sequences, labels) are logarithms; sequences stand in descending order of length.
    """
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    a, live = np.exp(trans), _steps(lengths)
    alpha, pair = np.zeros_like(e), np.zeros_like(trans, dtype=np.float64)
    if not len(live):
        return alpha, pair
    alpha[0] = e[0] * np.exp(start)
    for t in range(1, len(live)):
        n = live[t]
        x = (alpha[t - 1, :n] @ a) * e[t, :n]
        if t % RESCALE == 0:
            x /= x.sum(axis=1, keepdims=True)
        alpha[t, :n] = x
    beta, back = np.ones_like(e[0]), a.T.copy()
    for t in range(len(live) - 2, -1, -1):
        n = live[t + 1]
        after = e[t + 1, :n] * beta[:n]
        x = after @ back
        if pairs:
            z = (alpha[t, :n] * x).sum(axis=1, keepdims=True)
            pair += ((alpha[t, :n] / z).T @ after) * a
        if t % RESCALE == 0:
            x /= x.sum(axis=1, keepdims=True)
        beta[:n] = x
        alpha[t, :n] *= x
    return alpha / np.maximum(alpha.sum(axis=2, keepdims=True), 1e-300), pair


class Model:
    """Weights of the features, transitions and start scores; scores of words are cached by their hash."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), np.float32)

    def score(self, w: Words) -> np.ndarray:
        """Scores (words, labels); words without letters have none."""
        kinds, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.empty(len(kinds), np.int64)
        for i, h in enumerate(kinds.tolist()):
            p = self.known.get(h)
            if p is None:
                text = w.text(at[i])
                p = len(self.known)
                if p == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                if any(c.isalpha() for c in text):
                    self.rows[p] = self.weights[features(text)].sum(axis=0)
                else:
                    self.rows[p] = 0
                self.known[h] = p
            place[i] = p
        scores = self.rows[place][back]
        if len(self.known) > 400_000:  # a bound on the worker's memory
            self.known.clear()
        return scores

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The most likely label of each word and its probability."""
        bounds = w.bounds()
        lengths = np.diff(bounds)
        labels, sure = np.zeros(len(w.hash), np.int8), np.zeros(len(w.hash), np.float32)
        scores = self.score(w)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        # groups of similar length, so that a very long text pads no other
        while len(order):
            longest = lengths[order[0]]
            take = max(1, min(len(order), 4_000_000 // (int(longest) * len(LANGUAGES)), int((lengths[order] > longest // 2).sum())))
            own, order = order[:take], order[take:]
            size = lengths[own]
            inside = np.arange(longest)[:, None] < size[None, :]
            at = np.minimum(bounds[own][None, :] + np.arange(longest)[:, None], len(w.hash) - 1)
            marginal, _ = forward_backward(scores[at], size, self.trans, self.start)
            marginal, at = marginal[inside], at[inside]
            labels[at] = best = marginal.argmax(axis=1)
            sure[at] = marginal[np.arange(len(best)), best]
        return labels, sure


def fit(w: Words, labels: np.ndarray, known: np.ndarray, rounds: int, trans: np.ndarray, start: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """The random field for words with labels where known, by Adam on the likelihood of whole texts; with weights to go on from, it
    learns the transitions too."""
    learn_trans = weights is not None
    n = len(LANGUAGES)
    kinds, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    lists = [features(w.text(i)) if any(c.isalpha() for c in w.text(i)) else [] for i in at]
    size = np.array([len(x) for x in lists])
    flat = np.array([f for x in lists for f in x], np.int64)
    owner = np.repeat(np.arange(len(kinds)), size)
    weights = np.zeros((BUCKETS, n), np.float32) if weights is None else weights.copy()
    mean, seen = np.zeros((BUCKETS, n), np.float32), np.zeros((BUCKETS, n), np.float32)
    trans, start, seen_t = trans.copy(), start.copy(), np.full((n, n), 1.0)
    bounds = w.bounds()
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    longest = lengths[order[0]] if len(order) else 0
    inside = np.arange(longest)[:, None] < lengths[order][None, :]
    index = np.minimum(bounds[order][None, :] + np.arange(longest)[:, None], len(w.hash) - 1)
    hot = np.zeros((len(w.hash), n), np.float32)
    hot[np.arange(len(w.hash)), labels] = 1
    same_row = w.row[1:] == w.row[:-1]
    ok = same_row & known[1:] & known[:-1]
    counted = np.zeros((n, n))
    np.add.at(counted, (labels[:-1][ok], labels[1:][ok]), 1)
    for step in range(1, rounds + 1):
        kind_scores = np.stack([np.bincount(owner, weights[flat, k], len(kinds)) for k in range(n)], axis=1).astype(np.float32)
        scores = kind_scores[back]
        marginal, pair = forward_backward(scores[index], lengths[order], trans, start, learn_trans)
        p = np.zeros_like(hot)
        p[index[inside]] = marginal[inside]
        d = (hot - p) * known[:, None]
        dk = np.stack([np.bincount(back, d[:, k], len(kinds)) for k in range(n)], axis=1)
        g = np.stack([np.bincount(flat, dk[owner, k], BUCKETS) for k in range(n)], axis=1).astype(np.float32) - 1e-3 * weights
        mean += 0.2 * (g - mean)
        seen += 0.1 * (g * g - seen)
        weights += RATE * (mean / (1 - 0.8**step)) / (np.sqrt(seen / (1 - 0.9**step)) + 1e-2)
        if learn_trans:
            gt = counted - pair * (counted.sum() / max(pair.sum(), 1e-9)) - 0.1 * trans
            seen_t += gt * gt
            trans += 0.1 * gt / np.sqrt(seen_t)
    return Model(weights, trans, start)


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model for texts with one label each, some of them wrong and some texts of several languages."""
    n = len(LANGUAGES)
    w = words(texts)
    stay = np.full((n, n), np.log(0.01 / (n - 1)))
    np.fill_diagonal(stay, np.log(0.99))
    start = np.zeros(n)
    if not len(w.hash):
        return Model(np.zeros((BUCKETS, n), np.float32), stay, start)
    own = labels[w.row].astype(np.int64)
    first = fit(w, own, np.ones(len(own), bool), 15, np.zeros((n, n)), start)  # word by word
    path, _ = Model(first.weights, stay, start).label(w)
    share = np.zeros((w.rows, n))
    np.add.at(share, (w.row, path), 1)
    agrees = share.argmax(axis=1) == labels
    return fit(w, path.astype(np.int64), agrees[w.row], 8, stay, start, first.weights)


def training_pages(pages: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """text, lang: up to per_language pages of each language whose labels don't contradict each other, chosen by the hash of the key,
    without those over TRAIN_CHARS."""
    coded = labels.select("page_id", language_code(F.col("lang")).alias("lang")).filter(F.col("lang").isNotNull() & F.col("page_id").isNotNull())
    agreed = coded.groupBy("page_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).filter(F.col("lang") == F.col("other"))
    ranked = agreed.select("page_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("page_id"), "page_id")).alias("n")).filter(F.col("n") <= per_language)
    chosen = F.broadcast(ranked.select("page_id", "lang"))  # at most per_language rows of each language
    return pages.select("page_id", "text").join(chosen, "page_id").filter(F.length("text").between(21, TRAIN_CHARS)).select("text", "lang")


def _runs(labels: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end, label) of the stretches of one text: runs with too few letters join the longer neighbour, shortest first."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
    begin, end = cut[:-1].tolist(), cut[1:].tolist()
    total = np.concatenate(([0], np.cumsum(letters)))
    label, size = labels[cut[:-1]].tolist(), (total[cut[1:]] - total[cut[:-1]]).tolist()
    n = len(begin)
    before, after, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(size[i], i) for i in range(n)]
    heapq.heapify(heap)

    def absorb(i: int, k: int) -> None:
        """Run i becomes a part of its neighbour k."""
        begin[k], end[k], size[k] = min(begin[i], begin[k]), max(end[i], end[k]), size[i] + size[k]
        live[i] = False
        x, y = before[i], after[i]
        if x >= 0:
            after[x] = y
        if y >= 0:
            before[y] = x

    left = n
    while left > 1 and heap:
        letters_of, i = heapq.heappop(heap)
        if not live[i] or letters_of != size[i]:
            continue
        if letters_of >= LEAST_LETTERS:
            break
        k = max((x for x in (before[i], after[i]) if x >= 0), key=lambda x: size[x])
        absorb(i, k)
        left -= 1
        for x in (before[k], after[k]):  # the other side may be of the same language
            if x >= 0 and label[x] == label[k]:
                absorb(x, k)
                left -= 1
        heapq.heappush(heap, (size[k], k))
    return sorted((begin[i], end[i], label[i]) for i in range(n) if live[i])


def stretches(pages: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """page_id, seg_no, lang, confidence, begin, end: the stretches of each page in reading order, by characters of its repaired text.

    Null, blank and letterless texts give no row; repeated pages a row each; without usable labels the first language is given with low
    confidence; extra columns are not read.
    """
    spark = pages.sparkSession
    drawn = training_pages(pages, labels, per_language).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])  # bounded by per_language
    texts = repair_column(drawn.column("text").combine_chunks())
    model = train(texts, np.array([LANGUAGES.index(x) for x in drawn.column("lang").to_pylist()], np.int64))
    sent = spark.sparkContext.broadcast((model.weights, model.trans, model.start))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                w = words(repair_column(part.column("text")))
                path, sure = model.label(w)
                letter = np.concatenate(([0], np.cumsum(letter_mask(w.points))))
                letters = letter[w.end] - letter[w.start]
                bounds = w.bounds()
                row, no, lang, conf, begin, end = [], [], [], [], [], []
                has = np.add.reduceat(np.append(letters, 0), np.minimum(bounds[:-1], len(letters))) * (np.diff(bounds) > 0)
                for r in np.flatnonzero(has > 0):
                    a, b = bounds[r], bounds[r + 1]
                    own = path[a:b]
                    spans = [(0, b - a, int(own[0]))] if (own == own[0]).all() else _runs(own, letters[a:b])
                    for k, (x, y, label) in enumerate(spans, 1):
                        right = sure[a + x : a + y][own[x:y] == label]
                        row.append(r), no.append(k), lang.append(LANGUAGES[label]), conf.append(float(right.sum()) / (y - x))
                        begin.append(int(w.start[a + x] - w.begins[r])), end.append(int(w.end[a + y - 1] - w.begins[r]))
                yield pa.RecordBatch.from_arrays([part.column("page_id").take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["page_id", "seg_no", "lang", "confidence", "begin", "end"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "text").filter(F.col("text").isNotNull()).mapInArrow(run, f"page_id {kind}, seg_no int, lang string, confidence double, begin int, end int")


def page_languages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, lang, confidence: the language that most of a page is in, by characters; ties go to the one that comes first."""
    size = F.col("end") - F.col("begin")
    each = stretches(pages, labels).groupBy("page_id", "lang").agg(F.sum(size).alias("size"), F.min("seg_no").alias("first"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    best = each.groupBy("page_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("size", -F.col("first"))).alias("b"))
    return best.select("page_id", "b.lang", "b.confidence")
