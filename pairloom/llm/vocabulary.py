"""Vocabulary files of public tokenizers, read on the driver and broadcast.

A vocabulary has a fixed size (tens of thousands of short byte strings, under
2 MB), whatever the size of the corpus; that is the bound of the broadcast.
"""

from __future__ import annotations

import base64
import json

import numpy as np

# The white space that the tokenizers' patterns mean by \s (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def rank_file(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + place) for place, b in enumerate(hidden)}


class MergeTable:
    """Merges of a byte-level BPE file as sorted arrays: pair key, rank, merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = [t["content"] for t in data["added_tokens"] if t["special"]]
        self.size = 1 + max(vocab.values())
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
