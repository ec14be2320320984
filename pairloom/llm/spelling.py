"""Spelling variants: words one edit apart, found through k-d trees over letter counts.

A replaced letter changes two letter counts by one, an inserted or deleted letter
changes one. So the words near a word lie in a small box around its letter counts,
and a k-d tree over the counts of all words of one length finds them: a search
descends only into boxes that the counts can reach with one letter more and one
letter less (same length) or with one letter more (next length). What is left is
compared letter by letter.

The upper part of each length's tree is fitted on a bounded sample of the words and
only deals the work out: every word lives in one leaf and is sent to the leaves its
search reaches. Leaves with many words are cut into blocks, so a task holds one block
of words and one of searches, whatever the number of words with the same letters.
Inside, a second tree with tight boxes prunes again.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import first_column, pinned, text_slices, tidied
from pairloom.operators.joins import lookup_join

# In UTF-8, U+00C0 to U+00FF are C3 followed by one byte.
_RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
_HELD_WORDS = 200_000
DIMENSIONS = 26 + 64
_NODE = 16
_PAIRS = 1 << 15
_DEPTH = 64  # limits the tree's depth only: leaves of any size are cut into blocks
# What a word does in a leaf.
LIVES, ASKS_HERE, ASKS_ELSEWHERE = 0, 1, 2


def damaged(run: bytes, digest: int, every: int) -> bytes:
    """``run`` without the code point at ``digest`` modulo its length, where ``every`` divides ``digest``."""
    if digest % every:
        return run
    letters = run.decode()
    place = digest % len(letters)
    return (letters[:place] + letters[place + 1:]).encode()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """The distinct words (word, n) of all whole texts with at least ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. If
    ``every`` divides the CRC-32 of ``<key>:<run>``, the run loses one code point (0: no
    run does). Null texts have no words; a null key is written as the empty string; every
    row counts, repeated ones too. Tasks sum a bounded table of words before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in text_slices(batches):
            texts = first_column(part, "text").cast(pa.binary()).to_pylist()
            for name, whole in zip(first_column(part, "key").to_pylist(), texts, strict=True):
                if not whole:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(_RUN.findall(whole.lower())).items():
                    if len(word) < least_length:
                        continue
                    if every:
                        word = damaged(word, zlib.crc32(word, start), every)
                    if len(word) - word.count(b"\xc3") >= least_length:
                        held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield emptied()
        if held:
            yield emptied()

    rows = docs.select(docs[key].cast("string").alias("key"), docs[text].alias("text"))
    counts = rows.mapInArrow(tidied(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length (rows), and their letter counts: a-z, then U+00C0 to U+00FF."""
    length = len(words[0]) if words else 0
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.int32)
    place = np.where(codes < 0x80, codes - ord("a"), codes - 0xC0 + 26)
    flat = place + np.arange(len(words))[:, None] * DIMENSIONS
    return codes, np.bincount(flat.ravel(), minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS).astype(np.int32)


def best_cut(counts: np.ndarray) -> tuple[int, int, int] | None:
    """(letter, limit, words up to the limit) of the cut that halves the words best; None if all counts agree."""
    if not len(counts):
        return None
    low, high = counts.min(0), counts.max(0)
    best = None
    for letter in np.flatnonzero(low < high):
        below = np.cumsum(np.bincount(counts[:, letter] - low[letter]))[:-1]
        limit = int(np.abs(2 * below - len(counts)).argmin())
        if best is None or abs(2 * below[limit] - len(counts)) < abs(2 * best[2] - len(counts)):
            best = (int(letter), int(low[letter] + limit), int(below[limit]))
    return best


class Tree:
    """The cuts of a k-d tree. An inner node holds (letter, limit, box before the cut, children), a leaf its number."""

    def __init__(self, counts: np.ndarray, leaf: float):
        self.leaves = 0
        self.root = self.grown(counts, leaf, {})

    def grown(self, counts: np.ndarray, leaf: float, box: dict[int, tuple[float, float]], depth: int = 0):
        cut = best_cut(counts) if len(counts) > leaf and depth < _DEPTH else None
        if cut is None:
            self.leaves += 1
            return self.leaves - 1
        letter, limit, _ = cut
        low, high = box.get(letter, (0, math.inf))
        left = counts[:, letter] <= limit
        return (letter, limit, low, high,
                self.grown(counts[left], leaf, box | {letter: (low, limit)}, depth + 1),
                self.grown(counts[~left], leaf, box | {letter: (limit + 1, high)}, depth + 1))

    def reached(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows that reach its box when at most ``more`` letters are added and ``less`` taken away."""
        rows = np.arange(len(counts))
        zero = np.zeros(len(counts), np.int32)
        stack = [(self.root, rows, zero, zero)]
        while stack:
            node, rows, added, taken = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            letter, limit, low, high, left, right = node
            value = counts[rows, letter]
            # A tighter limit on a letter replaces what the box asked of it before.
            taken_left = taken + np.maximum(value - limit, 0) - np.maximum(value - high, 0).astype(np.int32)
            added_right = added + np.maximum(limit + 1 - value, 0) - np.maximum(low - value, 0)
            keep = taken_left <= less
            stack.append((left, rows[keep], added[keep], taken_left[keep]))
            keep = added_right <= more
            stack.append((right, rows[keep], added_right[keep], taken[keep]))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(length, row numbers, words) of each length, ascending."""
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, [words[i] for i in rows]


def fitted_trees(words: DataFrame, leaf_words: int, sample_words: int) -> dict[int, Tree]:
    """One tree per length from at most about ``sample_words`` words, cut until a leaf stands for about ``leaf_words``."""
    total = words.count()
    share = min(1.0, sample_words / max(total, 1))
    chosen = words if share == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = chosen.select("word").toArrow().column(0).to_pylist()
    return {length: Tree(letters_of(some)[1], max(leaf_words * share, 8)) for length, _, some in by_length(sample)}


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` (code points) differ from those of ``b`` by one replaced code point, or by one inserted into ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :-1], 1).sum(1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return ahead + behind >= a.shape[1]


def near_in_block(counts: np.ndarray, codes: np.ndarray, asked: np.ndarray, asked_codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``asked``, rows of ``counts``) one edit apart; ``asked`` words are as long as the others or one letter shorter."""
    less = 1 if codes.shape[1] == asked_codes.shape[1] else 0
    stack = [(np.arange(len(counts)), np.arange(len(asked)))]
    while stack:
        rows, searches = stack.pop()
        box = counts[rows]
        low, high = box.min(0), box.max(0)
        some = asked[searches]
        searches = searches[(np.maximum(low - some, 0).sum(1) <= 1) & (np.maximum(some - high, 0).sum(1) <= less)]
        if not len(searches):
            continue
        cut = best_cut(box) if len(rows) > _NODE else None
        if cut is not None:
            left = box[:, cut[0]] <= cut[1]
            stack += [(rows[left], searches), (rows[~left], searches)]
            continue
        step = max(1, _PAIRS // len(rows))
        for start in range(0, len(searches), step):
            part = searches[start:start + step]
            change = counts[rows][None] - asked[part][:, None]
            ask, row = np.nonzero((np.maximum(change, 0).sum(2) == 1) & (np.maximum(-change, 0).sum(2) == less))
            found = one_edit(asked_codes[part[ask]], codes[rows[row]])
            yield part[ask[found]], rows[row[found]]


def near_pairs(words: DataFrame, leaf_words: int = 512, block_words: int = 4096, sample_words: int = 1 << 18) -> DataFrame:
    """Every pair of ``words`` (word, n; distinct) one inserted, deleted or replaced code point apart, both ways: (word, near, near_n)."""
    trees = words.sparkSession.sparkContext.broadcast(fitted_trees(words, leaf_words, sample_words))
    alone = Tree(np.zeros((0, DIMENSIONS), np.int32), 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = first_column(batch, "word").to_pylist()
            for length, rows, some in by_length(names):
                _, counts = letters_of(some)
                places = np.empty(len(some), np.int64)
                own, next_tree = trees.value.get(length, alone), trees.value.get(length + 1, alone)
                for leaf, found in own.reached(counts, 0, 0):
                    places[found] = leaf
                parts = [(length, places, rows, LIVES), (length, places, rows, ASKS_HERE)]
                for leaf, found in own.reached(counts, 1, 1):
                    # Of two words in different leaves, the one in the leaf with the smaller number asks.
                    found = found[places[found] < leaf]
                    parts.append((length, np.full(len(found), leaf), rows[found], ASKS_ELSEWHERE))
                for leaf, found in next_tree.reached(counts, 1, 0):
                    parts.append((length + 1, np.full(len(found), leaf), rows[found], ASKS_ELSEWHERE))
                chosen = batch.take(pa.array(np.concatenate([p[2] for p in parts])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.full(len(p[2]), p[0], np.int64) for p in parts])), pa.array(np.concatenate([p[1] for p in parts])),
                    pa.array(np.concatenate([np.full(len(p[2]), p[3], np.int32) for p in parts])), first_column(chosen, "word"), first_column(chosen, "n"),
                ], names=["length", "leaf", "role", "word", "n"])

    placed = pinned(words.select("word", "n").mapInArrow(tidied(dealt), "length bigint, leaf bigint, role int, word string, n bigint"))
    asks = F.col("role") != LIVES
    blocks = [F.greatest(F.lit(1), F.ceil(F.count_if(c) / block_words)).cast("int") for c in (~asks, asks)]
    sizes = placed.groupBy("length", "leaf").agg(blocks[0].alias("homes"), blocks[1].alias("searches"))
    # One row per leaf: the sample's size over the least words of a leaf bounds their number, whatever the number of words.
    sized = placed.join(F.broadcast(sizes), ["length", "leaf"])
    own = F.pmod(F.xxhash64("word"), F.when(asks, F.col("searches")).otherwise(F.col("homes"))).cast("int")
    copies = F.when(asks, F.col("homes")).otherwise(F.col("searches"))
    dealt_out = sized.select("length", "leaf", "role", "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("other"))
    dealt_out = dealt_out.withColumns({
        "home": F.when(asks, F.col("other")).otherwise(F.col("own")), "search": F.when(asks, F.col("own")).otherwise(F.col("other"))}).drop("own", "other")

    def compared(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        home, search = group.filter(pa.array(role == LIVES)), group.filter(pa.array(role != LIVES))
        here = role[role != LIVES] == ASKS_HERE
        homes, searches = home.column("word").to_pylist(), search.column("word").to_pylist()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes, counts = letters_of(homes)
        for _, rows, some in by_length(searches) if homes else ():
            asked_codes, asked = letters_of(some)
            for a, b in near_in_block(counts, codes, asked, asked_codes):
                a = rows[a]
                # Words of one leaf ask each other: the smaller one's answer counts.
                once = ~here[a]
                once[~once] = [searches[i] < homes[j] for i, j in zip(a[~once], b[~once], strict=True)]
                left.append(a[once])
                right.append(b[once])
        one, two = search.take(pa.array(np.concatenate(left))), home.take(pa.array(np.concatenate(right)))
        return pa.table({"a": one.column("word"), "a_n": one.column("n"), "b": two.column("word"), "b_n": two.column("n")})

    found = dealt_out.groupBy("length", "leaf", "home", "search").applyInArrow(compared, "a string, a_n bigint, b string, b_n bigint")
    ways = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    return found.select(F.inline(F.array(*ways)))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that the forms lead to. Every round doubles the steps taken; forms must not circle."""
    links = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = pinned(lookup_join(links, onward, "root", "left", spread_by=["word"]))
        if step.where(F.col("onward").isNotNull()).isEmpty():
            return links
        links = pinned(step.select("word", F.coalesce("onward", "root").alias("root")))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every one of ``words`` (word, n; distinct).

    A word's form is the near word with the largest n, of equals the first in code-point
    order, if its n is at least ``ratio`` (above 1) times the word's own, else null; root
    follows forms to their end. ``n_near`` counts the near words, 0 if there are none. An
    empty table gives no rows.
    """
    words = pinned(words)
    near = near_pairs(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    fits = F.col("best").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    known = pinned(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """The words of ``docs`` with their spelling forms: ``word_counts``, then ``variants``. Other columns are ignored."""
    return variants(word_counts(docs, key, text, least_length, least_count, every), ratio)
