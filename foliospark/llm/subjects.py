"""Subject areas of decisions (problem 10).

The sentences of the numbered paragraphs are sorted into the areas and a class for what deals with none: a naive Bayes mixture over hashed
words and word pairs, fitted by expectation-maximisation to labelled documents, in which a sentence deals with a labelled area or with
none; only words that labelled documents show to tell areas apart decide between areas. Each area's share of the paragraphs and of the
sentences, source and structure are the features of a chain of calibrated classifiers, each of which sees the decisions before it; a beam
search finds the best combination of areas.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import mix, words

#: Labelled documents that the classifiers are fitted on, at most, chosen by the hash of their key; and characters of such a document:
#: longer ones are not drawn, which bounds what comes to the driver.
TRAIN_DOCS, TRAIN_CHARS = 1500, 200_000
BUCKETS = 1 << 17
#: The beam of the search. The share of the paragraphs from which on an area counts is learned from the labels.
BEAM = 16
SOURCES = 32

_NUMBERED = re.compile(r"(?m)^[ \t]*(?:[(\[§]\s?|Rn\.? ?|no\.? ?)?(\d{1,4})(?:[)\].:]|[ \t ])\s?")


def area_name(label: Column) -> Column:
    """An area label in one spelling: lower case, without the word law."""
    return F.trim(F.regexp_replace(F.lower(label), r"\s+law\s*$", ""))


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the numbered paragraphs: lines whose numbers rise from 1, and lines that go on in small letters."""
    out, number = [], 0
    for m in _NUMBERED.finditer(text):
        n = int(m.group(1))
        if not number < n <= number + 3:
            continue
        number = n
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        while end + 1 < len(text) and text[end + 1].islower():
            after = text.find("\n", end + 1)
            end = len(text) if after < 0 else after
        out.append((m.end(), end))
    return out


class Sentences:
    """Sentences of the numbered paragraphs of a batch: their hashed features, paragraph and text numbers."""

    def __init__(self, texts: pa.Array):
        w = words(texts)
        spans, owner = [], []
        for r, t in enumerate(texts.to_pylist()):
            for a, b in paragraphs(t or ""):
                spans.append((a + w.begins[r], b + w.begins[r])), owner.append(r)
        self.rows = w.rows
        self.paragraph_row = np.array(owner, np.int64)
        at = np.array(spans, np.int64).reshape(-1, 2)
        # each word's paragraph, or -1
        p = np.searchsorted(at[:, 0], w.start, side="right") - 1
        inside = (p >= 0) & (w.start < at[np.maximum(p, 0), 1]) if len(at) else np.zeros(len(w.start), bool)
        letters = ~((w.points[np.minimum(w.start, max(0, len(w.points) - 1))] - np.uint32(48)) < 10) if len(w.start) else inside
        keep = inside & letters
        self.kept, self.p = w.hash[keep], p[keep]
        stop = np.zeros(len(w.points) + 1, np.int32)
        if len(w.points) > 1:
            ends = np.isin(w.points[:-1], (46, 33, 63)) & np.isin(w.points[1:], (32, 10, 13, 9, 0xA0))
            stop[1:-1] = np.cumsum(ends)
            stop[-1] = stop[-2]
        key = self.p * (int(stop[-1]) + 1) + stop[w.start[keep]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.first = np.flatnonzero(new)
        self.sentence = np.cumsum(new) - 1
        self.paragraph = self.p[self.first]
        pair = mix(self.kept[:-1] * np.uint64(3) ^ self.kept[1:]) if len(self.kept) else np.zeros(0, np.uint64)
        self.word = (self.kept & np.uint64(BUCKETS - 1)).astype(np.int64)
        same = self.sentence[1:] == self.sentence[:-1]
        self.pair = (pair[same] & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.pair_sentence = self.sentence[1:][same]

    def score(self, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Logarithms of the joint probabilities (sentences x classes)."""
        n = len(self.first)
        if not n:
            return np.zeros((0, table.shape[1]))
        out = np.add.reduceat(table[self.word], self.first, axis=0).astype(np.float64)
        if len(self.pair):
            begins = np.flatnonzero(np.diff(self.pair_sentence, prepend=-1))
            out[self.pair_sentence[begins]] += np.add.reduceat(table[self.pair], begins, axis=0)
        return out + prior

    def counts(self, r: np.ndarray) -> np.ndarray:
        """Expected feature counts (buckets x classes) for responsibilities of the sentences."""
        feature, owner = np.concatenate((self.word, self.pair)), np.concatenate((self.sentence, self.pair_sentence))
        return np.stack([np.bincount(feature, r[owner, k], BUCKETS) for k in range(r.shape[1])], axis=1)


def telling(s: Sentences, allowed: np.ndarray) -> np.ndarray:
    """Which features (buckets) tell areas apart: those that stand far more often in texts labelled with some area than in others.

    All else, the wording of the court above all, must not decide between areas, whatever it happens to be found with.
    """
    row = s.paragraph_row[s.paragraph] if len(s.first) else np.zeros(0, np.int64)
    feature = np.concatenate((s.word, s.pair))
    owner = np.concatenate((row[s.sentence], row[s.pair_sentence])) if len(row) else np.zeros(0, np.int64)
    once = np.unique(owner * BUCKETS + feature)
    owner, feature = once // BUCKETS, once % BUCKETS
    n = np.bincount(feature, minlength=BUCKETS).astype(float)
    base = allowed.mean(axis=0)
    out = np.zeros(BUCKETS, bool)
    for k in range(allowed.shape[1]):
        with_k = np.bincount(feature, allowed[owner, k].astype(float), BUCKETS)
        expected = n * base[k]
        z = (with_k - expected) / np.sqrt(expected * (1 - base[k]) + 1e-9)
        out |= (n >= 3) & (z > 4) & (with_k > np.minimum(0.9 * n, 2 * expected))
    return out


def fit_sentences(s: Sentences, allowed: np.ndarray, rounds: int = 12, other: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of features by class (areas, then none) and log-priors; allowed (texts x areas) are the labels."""
    areas = allowed.shape[1]
    own = allowed[s.paragraph_row[s.paragraph]] if len(s.first) else np.zeros((0, areas))
    may = np.concatenate((np.where(own > 0, 1.0, other), np.ones((len(own), 1))), axis=1)
    r = may * np.append(np.ones(areas), 0.7)
    r /= r.sum(axis=1, keepdims=True)
    table, prior = np.zeros((BUCKETS, areas + 1), np.float32), np.zeros(areas + 1)
    decides = telling(s, allowed)
    for step in range(rounds):
        c = s.counts(r)
        base = c.sum(axis=1, keepdims=True)
        # words are smoothed towards their share in the whole, which keeps rare ones from deciding
        share = base / max(base.sum(), 1e-9)
        p = (c + 20.0 * share + 1e-4) / (c.sum(axis=0, keepdims=True) + 20.0 + 1e-4 * BUCKETS)
        pooled = c[:, :areas].sum(axis=1, keepdims=True)
        pooled = (pooled + 20.0 * share + 1e-4) / (pooled.sum() + 20.0 + 1e-4 * BUCKETS)
        p[:, :areas] = np.where(decides[:, None], p[:, :areas], pooled)
        table = np.log(p).astype(np.float32)
        mass = r.sum(axis=0) + 1
        prior = np.log(mass / mass.sum())
        heat = min(1.0, 0.3 + 0.1 * step)
        x = s.score(table, prior) * heat + np.log(may)
        x -= x.max(axis=1, keepdims=True)
        r = np.exp(x)
        r /= r.sum(axis=1, keepdims=True)
    return table, prior


def text_features(s: Sentences, table: np.ndarray, prior: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (texts x areas x 4) of each area, and those of the text as a whole: structure and source."""
    areas = table.shape[1] - 1
    count = np.bincount(s.paragraph_row, minlength=s.rows)
    x = s.score(table, prior)
    deals = np.zeros((len(s.paragraph_row), areas), bool)
    weight = np.zeros((s.rows, areas))
    if len(x):
        best = x.argmax(axis=1)
        hit = best < areas
        deals[s.paragraph[hit], best[hit]] = True
        np.add.at(weight, (s.paragraph_row[s.paragraph[hit]], best[hit]), 1)
    share = np.zeros((s.rows, areas))
    np.add.at(share, s.paragraph_row, deals.astype(float))
    share /= np.maximum(count, 1)[:, None]
    sentences = np.bincount(s.paragraph_row[s.paragraph], minlength=s.rows) if len(s.first) else np.zeros(s.rows)
    hits = share * count[:, None]
    odds = np.log((hits + 0.25) / (count[:, None] - hits + 0.25))
    # terms: how far the words of the text as a whole speak for the area against the others
    own = np.stack((share, odds, np.maximum(odds - odds.mean(axis=1, keepdims=True), 0), weight / np.maximum(sentences, 1)[:, None]), axis=2)
    whole = np.zeros((s.rows, 2 + SOURCES))
    whole[:, 0] = np.log1p(count) - 2
    whole[:, 1] = np.log1p(sentences) - 3
    whole[np.arange(s.rows), 2 + source] = 1
    return own, whole


def _logistic(x: np.ndarray, y: np.ndarray, l2: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a regularised logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(l2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(own: np.ndarray, whole: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """Inputs of the k-th classifier: a constant, the area's and the text's features, the decisions so far."""
    return np.concatenate((np.ones((len(own), 1)), own[:, k], whole, before), axis=1)


def fit_chain(own: np.ndarray, whole: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each area its weights and the two numbers (slope, offset) that calibrate its scores, from the half left out."""
    areas, chain = labels.shape[1], []
    half = np.arange(len(labels)) % 2 == 0
    for k in range(areas):
        before = np.zeros((len(labels), areas))
        before[:, :k] = labels[:, :k]
        x, y = _inputs(own, whole, before, k), labels[:, k].astype(float)
        l2 = np.concatenate(([0.1], np.full(4, 0.05), np.full(whole.shape[1], 5.0), np.full(areas, 2.0)))
        score, target = np.zeros(len(y)), y
        for a, b in ((half, ~half), (~half, half)):
            score[b] = x[b] @ _logistic(x[a], y[a], l2) if a.any() and b.any() else 0
        platt = _logistic(np.stack((score, np.ones(len(y))), axis=1), target, np.array([1e-2, 1e-2])) if len(y) > 3 else np.array([1.0, 0.0])
        chain.append((_logistic(x, y, l2) if len(y) else np.zeros(x.shape[1]), platt))
    return chain


def decode(chain: list, own: np.ndarray, whole: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The most likely combination of areas of each text (texts x areas), and its probability, by beam search along the chain."""
    n, areas = len(own), len(chain)
    state, logp = np.zeros((n, 1, areas)), np.zeros((n, 1))
    for k, (weights, (slope, offset)) in enumerate(chain):
        width = state.shape[1]
        fixed = np.concatenate((np.ones((n, 1)), own[:, k], whole), axis=1)
        cut = fixed.shape[1]
        score = (fixed @ weights[:cut])[:, None] + state @ weights[cut:]
        z = np.clip(slope * score + offset, -30, 30)
        yes, no = logp - np.log1p(np.exp(-z)), logp - np.log1p(np.exp(z))
        chosen = state.copy()
        chosen[:, :, k] = 1
        state, logp = np.concatenate((chosen, state), axis=1), np.concatenate((yes, no), axis=1)
        if 2 * width > beam:
            best = np.argsort(-logp, axis=1, kind="stable")[:, :beam]
            state, logp = np.take_along_axis(state, best[:, :, None], 1), np.take_along_axis(logp, best, 1)
    best = logp.argmax(axis=1)
    return state[np.arange(n), best], np.exp(logp[np.arange(n), best])


def source_codes(sources: list) -> np.ndarray:
    return np.array([zlib.crc32((x or "").split("-")[0].encode()) % SOURCES for x in sources], np.int64)


def train(texts: pa.Array, sources: list, labels: np.ndarray) -> tuple:
    s = Sentences(texts)
    table, prior = fit_sentences(s, labels)
    own, whole = text_features(s, table, prior, source_codes(sources))
    has = np.bincount(s.paragraph_row, minlength=s.rows) > 0
    return table, prior, fit_chain(own[has], whole[has], labels[has])


def labelled(documents: DataFrame, labels: DataFrame, areas: list[str], most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, source, areas: up to most labelled documents, chosen by the hash of their key."""
    named = labels.select("doc_id", area_name(F.col("area")).alias("area")).filter(F.col("area").isin(*areas) & F.col("doc_id").isNotNull())
    chosen = named.groupBy("doc_id").agg(F.sort_array(F.collect_set("area")).alias("areas")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text", "source").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")  # at most so many rows


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, area, share, confidence: a row for each area of each document.

    share is the share of the numbered paragraphs that deal with the area, confidence the probability of the whole combination. Texts
    without numbered paragraphs, null and empty ones have no area; without usable labels no document has one; repeated rows give
    repeated rows; extra columns are not read.
    """
    spark = documents.sparkSession
    names = sorted(r["area"] for r in areas.select(area_name(F.col("area")).alias("area")).filter(F.col("area").isNotNull()).distinct().collect())  # the classes: a model has a column for each
    kind = documents.schema["doc_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"doc_id {kind}, area string, share double, confidence double")
    if not names:
        return nothing
    drawn = labelled(documents, labels, names, most).toArrow().sort_by("doc_id")  # bounded by most
    target = np.array([[a in own for a in names] for own in drawn.column("areas").to_pylist()], bool).reshape(-1, len(names))
    if not len(target):
        return nothing
    sent = spark.sparkContext.broadcast(train(drawn.column("text").combine_chunks(), drawn.column("source").to_pylist(), target))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior, chain = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                s = Sentences(part.column("text"))
                own, whole = text_features(s, table, prior, source_codes(part.column("source").to_pylist()))
                chosen, sure = decode(chain, own, whole)
                chosen = (chosen > 0) & (np.bincount(s.paragraph_row, minlength=s.rows) > 0)[:, None]
                r, k = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(r)), pa.array([names[x] for x in k], pa.string()), pa.array(own[r, k, 0]), pa.array(sure[r])], ["doc_id", "area", "share", "confidence"])

    rows = documents.select("doc_id", "text", "source").filter(F.length("text") > 0)
    return rows.mapInArrow(run, f"doc_id {kind}, area string, share double, confidence double")


def composition(found: DataFrame) -> DataFrame:
    """area, documents: how many documents deal with each area."""
    return found.groupBy("area").agg(F.count_distinct("doc_id").alias("documents"))



