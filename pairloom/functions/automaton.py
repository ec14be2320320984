"""Phrases found in token texts by one walk over each text.

The phrase table becomes a trie with failure links. Phrases and texts are tokens joined
by a space and set in spaces, so a match is a contiguous run of whole tokens. A table of
bounded size travels to the tasks; only hits become rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Phrases:
    """The trie over distinct phrases, and the number of the empty one, which is in every text."""

    def __init__(self, keys: list[str]):
        self.keys, self.empty = keys, {n for n, key in enumerate(keys) if key == ""}
        self.trie = ahocorasick.Automaton()
        for n, key in enumerate(keys):
            if key != "":
                self.trie.add_word(f" {key} ", n)
        if len(self.trie):
            self.trie.make_automaton()

    def found(self, text: str | None) -> set[int]:
        """The numbers of the phrases in a text; a null text has none."""
        if text is None:
            return set()
        return {n for _, n in self.trie.iter(f" {text} ")} | self.empty if len(self.trie) else set(self.empty)


def shared_phrases(spark: SparkSession, keys: list[str]) -> Broadcast:
    return spark.sparkContext.broadcast(Phrases(keys))


def hits(phrases: Broadcast, *texts: Column) -> Column:
    """``array<struct<key, sides>>`` of the phrases in any of a row's token texts; bit i of ``sides`` stands for the i-th text."""
    @F.arrow_udf("array<struct<key: string, sides: int>>")
    def kernel(*columns: pa.Array) -> pa.Array:
        table = phrases.value
        sizes, numbers, sides = [0], [], []
        for row in zip(*[c.to_pylist() for c in columns], strict=True):
            bits: dict[int, int] = {}
            for side, text in enumerate(row):
                for n in table.found(text):
                    bits[n] = bits.get(n, 0) | 1 << side
            numbers.extend(bits)
            sides.extend(bits.values())
            sizes.append(len(numbers))
        key = pa.array(table.keys, pa.string()).take(pa.array(numbers, pa.int64()))
        found = pa.StructArray.from_arrays([key, pa.array(sides, pa.int32())], names=["key", "sides"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)

    return kernel(*texts)


class PhrasePairs:
    """Pairs of phrases by their first phrase's number."""

    def __init__(self, pairs: list[tuple[str, str]]):
        keys = sorted({key for pair in pairs for key in pair})
        number = {key: n for n, key in enumerate(keys)}
        self.phrases, self.second = Phrases(keys), {}
        for one, two in pairs:
            self.second.setdefault(number[one], []).append(number[two])

    def counts(self, truth: set[int], output: set[int]) -> tuple[int, int, int, int]:
        """Pairs whole in both texts, in the truth only, in the output only, and those whose first phrase alone is in the output while the truth lacks the pair."""
        both = missed = extra = half = 0
        for one in truth | output:
            for two in self.second.get(one, ()):
                wanted, got = one in truth and two in truth, one in output and two in output
                both += wanted and got
                missed += wanted and not got
                extra += got and not wanted
                half += one in output and two not in output and not wanted
        return both, missed, extra, half

    def whole(self, found: set[int]) -> bool:
        return any(two in found for one in found for two in self.second.get(one, ()))


def shared_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> Broadcast:
    return spark.sparkContext.broadcast(PhrasePairs(pairs))


def pair_counts(pairs: Broadcast, truth: Column, output: Column) -> Column:
    """``struct<tp, fn, fp, half>`` of a row's two token texts, as :meth:`PhrasePairs.counts` counts them."""
    @F.arrow_udf("struct<tp: bigint, fn: bigint, fp: bigint, half: bigint>")
    def kernel(left: pa.Array, right: pa.Array) -> pa.Array:
        table = pairs.value
        found = table.phrases.found
        counts = np.array([table.counts(found(a), found(b)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], np.int64).reshape(-1, 4)
        return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=["tp", "fn", "fp", "half"])

    return kernel(truth, output)


def has_pair(pairs: Broadcast, text: Column) -> Column:
    """Whether a token text holds both phrases of some pair."""
    @F.arrow_udf("boolean")
    def kernel(texts: pa.Array) -> pa.Array:
        table = pairs.value
        return pa.array([table.whole(table.phrases.found(t)) for t in texts.to_pylist()], pa.bool_())

    return kernel(text)
