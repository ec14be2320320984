"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one flat symbol array with their lengths (a ragged
array). In each round every sequence applies its own lowest-rank pair at all its
places at once, all sequences in the same numpy operations; sequences without a
known pair leave the array with the number of symbols they have left. Only
pre-tokens a task has not met yet are merged, the rest come from a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import first_column, text_slices, tidied
from pairloom.llm.vocabulary import WHITE, MergeTable

_CACHE = 300_000
_SYMBOLS = 1 << 18
_NONE = np.iinfo(np.int64).max


def surviving_symbols(words: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each word when no pair of the table can be merged any more."""
    left = np.zeros(len(words), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    while len(symbol):
        # The pair that starts at each symbol; the last symbol of a word starts none.
        key = np.empty(len(symbol), np.int64)
        key[:-1] = np.where(word[1:] == word[:-1], symbol[:-1] * table.size + symbol[1:], -1)
        key[-1] = -1
        place = np.minimum(np.searchsorted(table.key, key), len(table.key) - 1)
        rank = np.where(table.key[place] == key, table.rank[place], _NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[starts, len(word)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == _NONE
        left[word[starts[done]]] = count[done]
        hit = (rank == np.repeat(lowest, count)) & (rank != _NONE)
        # In a run of the same pair (a a a a) every second place is merged, from the left.
        at = np.arange(len(hit))
        begins = hit & ~np.r_[False, hit[:-1]]
        run = np.maximum.accumulate(np.where(begins, at, 0))
        hit &= (at - run) % 2 == 0
        symbol = np.where(hit, table.merged[place], symbol)
        keep = ~np.r_[False, hit[:-1]] & ~np.repeat(done, count)
        symbol, word = symbol[keep], word[keep]
    return left


class _Counter:
    """Counts tokens of texts; remembers pieces and pre-tokens up to a bound."""

    def __init__(self, table: MergeTable, pattern: str):
        self.table = table
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.special = re.compile("|".join(map(re.escape, table.special))) if table.special else None
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.pieces) > _CACHE:
            self.pieces.clear()
        if len(self.words) > _CACHE:
            self.words.clear()
        split = {p: self.pattern.findall(p) for p in pieces}
        new, held = [], 0
        for w in {w for words in split.values() for w in words if w not in self.words}:
            new.append(w)
            held += len(w)
            if held > _SYMBOLS:
                self.merge(new)
                new, held = [], 0
        self.merge(new)
        words = self.words
        for p, of in split.items():
            self.pieces[p] = sum([words[w] for w in of])

    def merge(self, new: list[str]) -> None:
        if new:
            self.words.update(zip(new, surviving_symbols([w.encode() for w in new], self.table).tolist(), strict=True))

    def plain(self, texts: list[str]) -> list[int]:
        # Before a single space a pre-token always ends, unless the space lies within
        # or at the end of a longer run of white space; such texts are one piece.
        parts = []
        for text in texts:
            if _RUN.search(text):
                parts.append([text])
            else:
                first, *rest = text.split(" ")
                parts.append([first, *[" " + p for p in rest]])
        new = set().union(*parts).difference(self.pieces) if parts else set()
        if new:
            if len(self.pieces) > _CACHE:
                new = set().union(*parts)
            self.learn(new)
        get = self.pieces.__getitem__
        return [sum(map(get, p)) for p in parts]

    def count(self, texts: list[str]) -> list[int]:
        if self.special is None:
            return self.plain(texts)
        pieces, owner, total = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            cut = self.special.split(text) if "<" in text else [text]
            total[i] += len(cut) - 1
            pieces += cut
            owner += [i] * len(cut)
        for i, n in zip(owner, self.plain(pieces), strict=True):
            total[i] += n
        return total


_RUN = re.compile(r"\s \s|\s \Z")


def count_tokens(docs: DataFrame, table: MergeTable, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, bytes and tokens of each whole text, and whether the tokens exceed ``limit``.

    Special tokens of the file count as one token where their string occurs. A null
    text counts as empty: 0 bytes, 0 tokens. A null key stays null; repeated rows give
    repeated results; other columns are ignored, whatever their names; an empty table
    gives an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(table))  # plain arrays, which executors without this package can read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(SimpleNamespace(**shared.value), pattern)
        for part in text_slices(batches):
            texts = [t or "" for t in first_column(part, "text").to_pylist()]
            tokens = counter.count(texts)
            sizes = [len(t.encode()) for t in texts]
            columns = [first_column(part, "key"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tidied(run), schema)
