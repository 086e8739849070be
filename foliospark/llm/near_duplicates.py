"""Groups and pairs of records whose contents share most of their word shingles (problem 5).

SuperMinHash signatures: in step j every shingle of a set draws its next slot of a random permutation and the rank j + r; a set stops
once all its slots hold ranks below the step. Signatures are cut into bands; sets that agree in a band are candidates. A sketch of the
signature drops those that are far too unlike (four standard deviations), the rest is verified on the exact shingle sets. Equal sets
form one class beforehand, so a huge group of copies is one row in every step but the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import mix, words
from foliospark.session import materialise

#: Five slots a band: a pair of similarity 0.6 meets in one of 50 bands with 0.983, 0.65 with 0.998, 0.7 with 0.9999.
BANDS, ROWS = 50, 5
#: Slots and bits of the sketch.
SLOTS, BITS = 64, 4


#: Steps up to which the few swaps of a permutation are kept as a list rather than the whole permutation.
LISTED = 40


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """The signatures (sets x slots, uint64) of sets of 64-bit hashes; owner says to which set each element belongs, in ascending order.

    Every element walks a random permutation of the slots by swaps. Most stop after a few steps, so a swap is written down as a place and
    what it holds, and looked up among those before it; only what goes on for long gets a permutation of its own.
    """
    ranks = np.full((sets, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = ranks.ravel()
    draw, base = elements, owner * slots
    places: list[np.ndarray] = []
    holds: list[np.ndarray] = []
    state = None
    for j in range(slots):
        draw = mix(draw)
        # the upper 24 bits choose the slot, the lower 40 are the fraction of the rank j + r
        at = (j + (((draw >> np.uint64(40)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)).astype(np.uint16)
        if state is None:
            slot, here = at.copy(), np.full(len(at), j, np.uint16)
            for place, hold in zip(places, holds, strict=True):
                np.copyto(slot, hold, where=place == at)
                np.copyto(here, hold, where=place == j)
            places.append(at), holds.append(here)
        else:
            lane = np.arange(len(draw))
            slot = state[lane, at]
            state[lane, at] = state[:, j]
        np.minimum.at(flat, base + slot, (np.uint64(j) << np.uint64(48)) | (draw & np.uint64((1 << 40) - 1)))
        if j % 2 and j + 1 < slots:
            going = (ranks.max(axis=1) >> np.uint64(48)) > j
            stay = np.repeat(going, np.bincount(base // slots, minlength=sets))
            if not stay.all():
                draw, base = draw[stay], base[stay]
                places, holds = [x[stay] for x in places], [x[stay] for x in holds]
                state = None if state is None else state[stay]
            if not len(draw):
                break
            if state is None and j > LISTED:
                state, lane = np.tile(np.arange(slots, dtype=np.uint16), (len(draw), 1)), np.arange(len(draw))
                for place, hold in zip(places, holds, strict=True):
                    state[lane, place] = hold
                places, holds = [], []
    return ranks


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes, their owners (ascending), words per text, texts."""
    w = words(texts)
    at, hashed = w.runs(shingle)
    owner = w.row[at]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return hashed[new], owner[new], np.diff(w.bounds()), w.rows


def _keys(hashed: np.ndarray, owner: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two keys of each whole set, of 48 bits (the low byte is its size on a scale of 3 % steps) and 64 bits, and the size."""
    size = np.bincount(owner, minlength=sets)
    one, two = np.zeros(sets, np.uint64), np.zeros(sets, np.uint64)
    if len(owner):
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        one[owner[begins]] = np.add.reduceat(mix(hashed), begins)
        two[owner[begins]] = np.add.reduceat(mix(hashed ^ np.uint64(0x5BF03635)), begins)
    code = np.minimum(255, np.log(np.maximum(size, 1)) / np.log(1.03)).astype(np.uint64)
    return (mix(one) >> np.uint64(24) << np.uint64(8)) | code, mix(two), size


def signed(df: DataFrame, key: str, text: str, least_words: int, shingle: int) -> DataFrame:
    """key, a, b, sketch, bands of each row with enough words: its class (a, b), which equal shingle sets share, and its signature."""
    slots = BANDS * ROWS

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                hashed, owner, count, sets = _sets(part.column("text"), shingle)
                a, b, size = _keys(hashed, owner, sets)
                keep = np.flatnonzero((count >= least_words) & (size > 0))
                number = np.full(sets, -1)
                number[keep] = np.arange(len(keep))
                inside = number[owner] >= 0
                sig = super_minhash(hashed[inside], number[owner[inside]], len(keep), slots)
                band = np.zeros((len(keep), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band ^ sig[:, r::ROWS])
                band = mix(band ^ np.arange(BANDS, dtype=np.uint64)[None, :]) >> np.uint64(24)
                nibbles = (mix(sig[:, :SLOTS]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
                sketch = (nibbles[:, ::2] << BITS) | nibbles[:, 1::2]
                packed = np.zeros((len(keep), BANDS, 5), np.uint8)
                for k in range(5):
                    packed[:, :, k] = (band >> np.uint64(8 * k)) & np.uint64(255)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keep)), pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary())], ["key", "a", "b", "sketch", "bands"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(compute, f"key {df.schema[key].dataType.simpleString()}, a bigint, b bigint, sketch binary, bands binary")


#: Steps on the size scale that sets of similarity 0.6 can be apart: log(1 / 0.6) / log(1.03), and one for rounding.
REACH = 18
#: Entries of the band index that one block should hold.
BLOCK = 500_000
#: A band's hash that so many classes share is split over several blocks; it is looked for among one in SAMPLED classes.
CROWD, SAMPLED = 4096, 64
#: The rest of a band's hash with the kind of the entry in its two low bits, and the class.
_ENTRY = np.dtype([("h", "<u4"), ("low", "<u4"), ("high", "<u2")])
ALL, LEFT, RIGHT = range(3)


def _bands(column: pa.Array) -> np.ndarray:
    """The hashes (40 bits) of all bands, row after row."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 5)
    hashed = np.zeros(len(raw), np.uint64)
    for k in range(5):
        hashed |= raw[:, k].astype(np.uint64) << np.uint64(8 * k)
    return hashed


def _crowded(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of bands that very many classes share, and into how many parts the classes of each are split.

    A hash that is not among them though crowded only makes a large block; each of them stands for some CROWD classes, which bounds them.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bands(b.column("bands")).astype(np.int64))], ["h"])

    some = table.filter(F.pmod(F.xxhash64("a"), F.lit(SAMPLED)) == 0).dropDuplicates(["a"]).select("bands").mapInArrow(explode, "h bigint")
    often = some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD // SAMPLED).toArrow().sort_by("h")
    return often.column("h").to_numpy().astype(np.uint64), -(-often.column("n").to_numpy() * SAMPLED // CROWD)


def _index_blocks(parts: int, crowds):
    """Rows of a block number and packed entries (the rest of a band's hash, the class) for it: the index travels in blocks.

    A class counts once per batch, so a huge group of copies brings few entries. The classes of a crowded hash are split into parts, and
    every pair of parts meets in a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd, pieces = crowds.value
        for b in batches:
            a, first = np.unique(b.column("a").to_numpy().view(np.uint64), return_index=True)
            hashed, own = _bands(b.column("bands").take(pa.array(first))), np.repeat(a, BANDS)
            kind = np.full(len(own), ALL, np.uint64)
            if len(crowd):
                at = np.minimum(np.searchsorted(crowd, hashed), len(crowd) - 1)
                split = crowd[at] == hashed
                count = pieces[at[split]]
                h, o = np.repeat(hashed[split], count), np.repeat(own[split], count)
                mine = np.repeat((mix(own[split]) % count.astype(np.uint64)).astype(np.int64), count)
                other = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                tile = np.minimum(mine, other) << 20 | np.maximum(mine, other)
                h = mix(h ^ mix(tile.astype(np.uint64))) >> np.uint64(24)
                sides = np.where(mine == other, ALL, np.where(mine < other, LEFT, RIGHT)).astype(np.uint64)
                hashed, own, kind = np.concatenate((hashed[~split], h)), np.concatenate((own[~split], o)), np.concatenate((kind[~split], sides))
            block = (hashed % np.uint64(parts)).astype(np.int64)
            entry = np.empty(len(hashed), _ENTRY)
            entry["h"] = ((hashed // np.uint64(parts)) << np.uint64(2) | kind) & np.uint64(0xFFFFFFFF)
            entry["low"], entry["high"] = own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)
            order = np.argsort(block, kind="stable")
            block, entry = block[order], entry[order]
            begins = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(begins[1:], len(block))
            yield pa.RecordBatch.from_arrays([pa.array(block[begins].astype(np.int32)), pa.array([entry[x:y].tobytes() for x, y in zip(begins, ends, strict=True)], pa.binary())], ["block", "entries"])

    return run


def _block_pairs(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of a block that share a band's hash and whose sizes allow the similarity, a slice at a time."""
    entry = np.frombuffer(b"".join(raw), _ENTRY)
    own = entry["low"].astype(np.uint64) | (entry["high"].astype(np.uint64) << np.uint64(32))
    order = np.lexsort((own, entry["h"]))
    h, own = entry["h"][order], own[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    kind, h = h & 3, h >> 2
    size, at, d = own & 255, np.arange(len(h)), 1
    while True:
        at = at[at + d < len(h)]
        at = at[h[at] == h[at + d]]
        if not len(at):
            return
        k = kind[at] + kind[at + d]  # two of kind ALL, or one of either side
        near = at[((k == 2 * ALL) | (k == LEFT + RIGHT)) & (np.abs(size[at] - size[at + d]) <= REACH)]
        if len(near):
            yield pa.RecordBatch.from_arrays([pa.array(own[near]), pa.array(own[near + d])], ["x", "y"])
        d += 1


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, raw = None, []
    for b in batches:
        for at, entries in zip(b.column("block").to_pylist(), b.column("entries").to_pylist(), strict=True):
            if at != block:
                yield from _block_pairs(raw)
                block, raw = at, []
            raw.append(entries)
    yield from _block_pairs(raw)


def candidate_pairs(table: DataFrame, threshold: float) -> DataFrame:
    """x, y: keys a of classes that meet in a band and whose sketches don't rule out the threshold."""
    parts = max(12, table.count() * BANDS // BLOCK)
    crowds = table.sparkSession.sparkContext.broadcast(_crowded(table))  # a hash for CROWD classes or more
    index = table.select("a", "bands").mapInArrow(_index_blocks(parts, crowds), "block int, entries binary")
    met = index.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_met, "x bigint, y bigint").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    chance = 1 / (1 << BITS)
    expect = threshold + (1 - threshold) * chance
    least = int(SLOTS * (expect - 4 * (expect * (1 - expect) / SLOTS) ** 0.5))
    sketches = table.select("a", "b", "sketch").dropDuplicates(["a", "b"])
    one, two = sketches.select(F.col("a").alias("x"), F.col("sketch").alias("s")), sketches.select(F.col("a").alias("y"), F.col("sketch").alias("t"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS // 2) for c in ("s", "t"))
            d = s ^ t
            same = ((d & 15) == 0).sum(axis=1) + ((d >> 4) == 0).sum(axis=1)
            keep = pa.array(np.flatnonzero(same >= least))
            yield pa.RecordBatch.from_arrays([b.column("x").take(keep), b.column("y").take(keep)], ["x", "y"])

    return met.join(one, "x").join(two, "y").mapInArrow(alike, "x bigint, y bigint").distinct()


#: Bits of the filter that spares rows that are in no candidate pair the shuffle: 16 for each class wanted, at most so many.
MOST_BITS = 1 << 28


def _filter_bits(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of the classes in candidate pairs: put together word by word on the executors, of bounded size; it only
    lets too many through."""
    bits = min(MOST_BITS, 1 << max(16, (16 * wanted.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = mix(b.column("a").to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    got = wanted.mapInArrow(place, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def verified(df: DataFrame, table: DataFrame, text: str, least_words: int, shingle: int, threshold: float) -> DataFrame:
    """x, xb, y, yb, similarity: pairs of different classes (x, xb), (y, yb) with at least the threshold, exactly."""
    pairs = materialise(candidate_pairs(table, threshold), "candidates")
    twice = table.groupBy("a").agg(F.min("b").alias("one"), F.max("b").alias("two")).filter(F.col("one") != F.col("two")).select(F.col("a").alias("x"), F.col("a").alias("y"))
    pairs = pairs.unionByName(twice)
    wanted = pairs.select(F.col("x").alias("a")).union(pairs.select(F.col("y").alias("a"))).distinct()
    sent = df.sparkSession.sparkContext.broadcast(_filter_bits(wanted))  # bounded by MOST_BITS

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                hashed, owner, count, sets = _sets(batch.column("text").slice(i, 2000), shingle)
                a, b, size = _keys(hashed, owner, sets)
                at = mix(a) & np.uint64(64 * len(bits) - 1)
                hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(hashed.view(np.int64)))
                keep = pa.array(np.flatnonzero((count >= least_words) & (size > 0) & (hit > 0)))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)).take(keep), pa.array(b.view(np.int64)).take(keep), lists.take(keep)], ["a", "b", "set"])

    sets = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(hashes, "a bigint, b bigint, set array<bigint>")
    needed = materialise(sets.dropDuplicates(["a", "b"]), "sets")
    one, two = (needed.select(F.col("a").alias(n), F.col("b").alias(f"{n}b"), F.col("set").alias(f"s{n}")) for n in "xy")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, t in zip(b.column("sx"), b.column("sy"), strict=True):
                s, t = np.asarray(s.values), np.asarray(t.values)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(both / (len(s) + len(t) - both))
            sim = np.array(out)
            keep = pa.array(np.flatnonzero(sim >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(keep) for c in ("x", "xb", "y", "yb")), pa.array(sim).take(keep)], ["x", "xb", "y", "yb", "similarity"])

    joined = pairs.join(one, "x").join(two, "y").filter((F.col("x") != F.col("y")) | (F.col("xb") < F.col("yb")))
    return joined.mapInArrow(exact, "x bigint, xb bigint, y bigint, yb bigint, similarity double")


def near_duplicate_pairs(df: DataFrame, key: str = "id", text: str = "content", least_words: int = 40, shingle: int = 3, threshold: float = 0.6) -> DataFrame:
    """id_a, id_b, id_a < id_b: pairs of rows whose shingle sets have at least the threshold of their union in common.

    Null or blank contents and those under least_words take no part; rows with one key and one content count once, rows with one key and
    two contents take part with both; the result is distinct; an empty table gives no rows.
    """
    member = materialise(signed(df, key, text, least_words, shingle), "signed")
    links = verified(df, member, text, least_words, shingle, threshold).select("x", "xb", "y", "yb")
    again = member.groupBy("a", "b").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).filter(F.col("k1") != F.col("k2")).select(F.col("a").alias("x"), F.col("b").alias("xb"), F.col("a").alias("y"), F.col("b").alias("yb"))
    one, two = (member.select(F.col("a").alias(n), F.col("b").alias(f"{n}b"), F.col("key").alias(f"k{n}")) for n in "xy")
    pairs = links.unionByName(again).join(one, ["x", "xb"]).join(two, ["y", "yb"]).filter(F.col("kx") != F.col("ky"))
    return pairs.select(F.least("kx", "ky").alias("id_a"), F.greatest("kx", "ky").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "id", text: str = "content", least_words: int = 40, shingle: int = 3, threshold: float = 0.6) -> DataFrame:
    """key, group: every distinct row with enough words and the group it belongs to, named by its least key (a group of one has only
    itself).

    Groups are the connected components of the pairs, found over classes by union-find in rounds: every class takes the least label
    among its neighbours and its label's label, until nothing changes.
    """
    member = materialise(signed(df, key, text, least_words, shingle), "signed")
    links = materialise(verified(df, member, text, least_words, shingle, threshold).select("x", "xb", "y", "yb").select(F.xxhash64("x", "xb").alias("x"), F.xxhash64("y", "yb").alias("y")), "links")
    both = links.union(links.select("y", "x")).distinct()
    label = both.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(label, both["y"] == label["node"]).groupBy("x").agg(F.min("label").alias("near"))
        hook = label.join(near, label["node"] == near["x"], "left").select("node", F.least("label", "near").alias("next"), "label")
        root = hook.select(F.col("node").alias("next"), F.col("next").alias("root"))
        after = materialise(hook.join(root, "next", "left").select("node", F.least(F.coalesce("root", "next"), "next").alias("label"), F.col("label").alias("before")), "labels")
        changed = after.filter(F.col("label") != F.col("before")).limit(1).count()
        label = after.select("node", "label")
        if not changed:
            break
    node = member.select("key", F.xxhash64("a", "b").alias("node"))
    grouped = node.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    named = grouped.groupBy("label").agg(F.min("key").alias("group"))
    return grouped.join(named, "label").select(F.col("key").alias(key), "group").distinct()
