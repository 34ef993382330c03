"""Token ids by a public byte-level BPE."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import cached_property, lru_cache

#: The pattern that splits text before the merges (fixed value of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space, letters and digits that the two libraries may class differently.
RARE = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f¡-ԯ‐-‧‰-⁞぀-ヿ一-龥가-힣]")


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level tokenizer file as bytes.

    Such files write each byte as a printable character: itself if printable, else the next free
    code point from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as tokenizers gives them by default.

    The vocabulary runs in tiktoken, which is eight times as fast; texts with characters that its
    pattern may class differently, and texts that hold an added token, go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        self.fast = tiktoken.Encoding("cadence", pat_str=PATTERN, mergeable_ranks=byte_vocabulary(path), special_tokens={})
        with open(path, encoding="utf-8") as file:
            added = [x["content"] for x in json.load(file).get("added_tokens", [])]
        self.rare = re.compile("|".join([RARE.pattern, *map(re.escape, sorted(added))]))

    @cached_property
    def reference(self):
        """The file in tokenizers, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.rare.search(text):
            return self.reference.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def raw(self, text: str) -> bytes:
        ids = array("I", self.ids(text))
        if ids.itemsize != 4 or sys.byteorder != "little":
            return b"".join(x.to_bytes(4, "little") for x in ids)
        return ids.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    return Encoder(path)
