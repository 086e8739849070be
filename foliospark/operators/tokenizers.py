"""Tokenizers for chunking: white space, and sub-word vocabularies from files of public tokenizers.

A provider encodes a text to a list of tokens and back; it is built once by each Python worker. Paths are parameters; nothing is loaded
from a network.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import cache
from typing import Protocol

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which byte-level vocabularies cut text before their merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


@dataclass(frozen=True)
class Whitespace:
    """What stands between white space; decoding puts a blank between tokens."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


@dataclass(frozen=True)
class SubWord:
    """A sub-word vocabulary by its file: ranks (.tiktoken), a tokenizers file (.json) or a sentencepiece model (.model).

    No special tokens are added; strings that look like them are ordinary text. A sentence after the first begins with a blank, so that
    what chunks are packed from reads on when it is decoded.
    """

    name: str = "byte_bpe_multi_50k.tiktoken"
    folder: str = FOLDER

    def encode(self, text: str) -> list[int]:
        return _encoder(os.path.join(self.folder, self.name))[0](text)

    def decode(self, tokens: list[int]) -> str:
        return _encoder(os.path.join(self.folder, self.name))[1](tokens)


@cache
def _encoder(path: str):
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return enc.encode_ordinary, lambda ids: enc.decode(ids, errors="ignore")
    if path.endswith(".json"):
        from tokenizers import Tokenizer as FromFile

        t = FromFile.from_file(path)
        t.encode_special_tokens = True
        return lambda x: t.encode(x, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda x: model.encode(x), lambda ids: model.decode(ids)
