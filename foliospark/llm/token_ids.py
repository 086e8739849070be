"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 8).

Tree concatenation. A text is cut, half by half, into leaves; leaves are encoded in parallel and joined pairwise. A cut lies where the
pre-tokenizer splits whatever stands around, if there is such a place in the piece; the join is then a plain concatenation. A stretch
without such a place is one or a few pre-tokens, whose bounds follow from its characters; a pre-token that is longer than a leaf is halved
as well. At such a join a window of tokens around it, all inside the pre-token, is encoded again and grown until the token before it and
the token after it fit their new neighbours. A sequence whose neighbouring tokens all fit is the one encoding of its bytes, so the result
equals that of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"


@cache
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The ranks of a vocabulary: a fixed 0.8 MB, read on the driver and sent to the executors."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


OTHER, SPACE, LETTER, NUMBER = range(4)
#: How a pre-token goes on after an apostrophe at its start. Fixed values, as in PATTERN.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    """The class of every code point, as the tokenizer's own pattern engine has it: a pattern of one class drops all else."""
    import tiktoken

    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        enc = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for at in range(0, len(chars), 256):
            out[[ord(c) for c in bytes(enc.encode_ordinary("".join(chars[at : at + 256]))).decode()]] = kind
    return out


def certain_splits(text: str) -> np.ndarray:
    """The positions where the pre-tokenizer splits whatever stands around them.

    Before white space that follows something else; after letters and after numbers when another class follows; and after signs, except
    between an apostrophe and a letter, which may be a contraction.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    c = _classes()[points]
    p, q = c[:-1], c[1:]
    contraction = (points[:-1] == ord("'")) & (q == LETTER)
    return np.flatnonzero((p != q) & (p != SPACE) & ~contraction) + 1


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a stretch without certain splits: white space, then signs, letters or numbers, letters after an apostrophe."""
    c = _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    at = int(np.argmax(c != SPACE)) if (c != SPACE).any() else len(c)
    if at == len(c):
        return [text]
    # the last white space goes with what follows if it is a blank
    cuts = {at - 1, at if at and text[at - 1] != " " else 0}
    if c[at] == OTHER and c[-1] == LETTER:
        letters = at + int(np.argmax(c[at:] == LETTER))
        bare = letters == at + 1 and (at == 0 or text[at - 1] != " ")  # the apostrophe alone begins a pre-token
        short = next((x for x in CONTRACTIONS if text.startswith(x, letters)), None) if bare else None
        cuts.add(letters if short is None else letters + len(short))
    cuts = [0, *sorted(x for x in cuts if 0 < x < len(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


#: What a leaf is: whole pre-tokens, the first or a further part of one long pre-token.
WHOLE, FIRST, FURTHER = range(3)


def leaves(text: str, leaf: int) -> list[tuple[str, int]]:
    """The text cut half by half into leaves of at most leaf characters, and what each is."""
    if len(text) <= leaf:
        return [(text, WHOLE)]
    splits = certain_splits(text)
    out: list[tuple[str, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            out.append((text[a:b], WHOLE))
            continue
        lo, hi = np.searchsorted(splits, (a + 1, b))
        if lo < hi:
            mid = lo + np.searchsorted(splits[lo:hi], (a + b) // 2)
            at = min((int(splits[k]) for k in (mid - 1, mid) if lo <= k < hi), key=lambda x: abs(2 * x - a - b))
            todo += [(at, b), (a, at)]
            continue
        for token in pre_tokens(text[a:b]):
            parts = 1 << (-(-len(token) // leaf) - 1).bit_length()
            size = -(-len(token) // parts)
            out += [(token[i : i + size], FURTHER if i else FIRST) for i in range(0, len(token), size)]
    return out


def encode_leaf(enc, text: str, what: int) -> list[int]:
    return enc.encode_ordinary(text) if what == WHOLE else enc._core_bpe.encode_single_piece(text.encode())


def join(enc, a: list[int], b: list[int]) -> list[int]:
    """The encoding of the concatenation of two encoded parts of one pre-token."""
    piece, raw = enc._core_bpe.encode_single_piece, enc.decode_single_token_bytes

    def fits(x: int, y: int) -> bool:
        return piece(raw(x) + raw(y)) == [x, y]

    if fits(a[-1], b[0]):
        return a + b
    left = right = 2
    while True:
        left, right = min(left, len(a)), min(right, len(b))
        new = piece(enc.decode_bytes(a[len(a) - left :] + b[:right]))
        good_left = left == len(a) or fits(a[len(a) - left - 1], new[0])
        good_right = right == len(b) or fits(new[-1], b[right])
        if good_left and good_right:
            return a[: len(a) - left] + new + b[right:]
        left, right = left * (1 if good_left else 2), right * (1 if good_right else 2)


def join_all(enc, parts: list[tuple[list[int], int]]) -> list[int]:
    """The ids of neighbouring leaves as one list: the parts of each long pre-token are joined as a tree, the rest is put in a row."""
    out: list[int] = []
    at = 0
    while at < len(parts):
        end = at + 1
        while end < len(parts) and parts[end][1] == FURTHER:
            end += 1
        own = [ids for ids, _ in parts[at:end]]
        while len(own) > 1:
            own = [join(enc, *own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
        out += own[0]
        at = end
    return out


def encode(enc, text: str, leaf: int = 2048, what: int = WHOLE) -> list[int]:
    if what != WHOLE:
        parts = [(text[i : i + leaf], FURTHER if i else what) for i in range(0, len(text), leaf)]
        return join_all(enc, [(encode_leaf(enc, x, w), FURTHER if i else FIRST) for i, (x, w) in enumerate(parts)])
    return join_all(enc, [(encode_leaf(enc, x, w), w) for x, w in leaves(text, leaf)])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf_chars: int = 2048, spread_chars: int = 32768) -> DataFrame:
    """key and ids (array<int>) of every row, without special tokens; strings that look like special tokens are ordinary text.

    Null and empty texts give an empty list, blank texts their own tokens; keys may be null or repeated, each row keeps its own result
    row; an empty table gives no rows; other columns are not read. A text is encoded as a tree of leaves of leaf_chars at most; one over
    spread_chars is first cut into pieces of that size, which are encoded all over the cluster.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(vocabulary, folder))  # fixed size
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    is_long = F.length("_text") > spread_chars

    def lists(encoded: list) -> pa.Array:
        flat = np.concatenate([np.asarray(x, np.int32) for x in encoded]) if encoded else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in encoded]))), pa.int32()), pa.array(flat, pa.int32()))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out = [encode(enc, t, leaf_chars) if t else [] for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_key"), lists(out)], ["_key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row, t in zip(b.column("_key"), b.column("_row").to_pylist(), b.column("_text").to_pylist(), strict=True):
                parts = leaves(t, spread_chars)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(parts), b.schema.field("_key").type), pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([w for _, w in parts], pa.int8()), pa.array([x for x, _ in parts], pa.string())], ["_key", "_row", "_no", "_what", "_text"])

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value)
        for b in batches:
            out = [encode(enc, t, leaf_chars, w) for t, w in zip(b.column("_text").to_pylist(), b.column("_what").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_key", "_row", "_no", "_what")), lists(out)], ["_key", "_row", "_no", "_what", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value)
        for b in batches:
            for i, parts in enumerate(b.column("parts")):
                ordered = [(p["ids"], p["_what"]) for p in sorted(parts.as_py(), key=lambda p: p["_no"])]
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(i, 1), lists([join_all(enc, ordered)])], ["_key", "ids"])

    name = kind.simpleString()
    direct = rows.filter(F.coalesce(~is_long, F.lit(True))).mapInArrow(short, f"_key {name}, ids array<int>")
    pieces = rows.filter(is_long).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, f"_key {name}, _row bigint, _no int, _what tinyint, _text string")
    encoded = pieces.repartition("_row", "_no").mapInArrow(leaf_ids, f"_key {name}, _row bigint, _no int, _what tinyint, ids array<int>")
    whole = encoded.groupBy("_key", "_row").agg(F.collect_list(F.struct("_no", "_what", "ids")).alias("parts")).select("_key", "parts").mapInArrow(joined, f"_key {name}, ids array<int>")
    return direct.unionByName(whole).withColumnRenamed("_key", key)
