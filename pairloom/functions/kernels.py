"""The Arrow functions: per-row sequence work that built-in expressions do too slowly.

Each works on one Arrow batch inside a task and returns one value per row, so it
needs no shuffle; every aggregation after it is ordinary Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKENS_PER_SLICE = 1 << 16


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges whose tokens stay near the bound, so memory does not grow with the batch."""
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > _TOKENS_PER_SLICE:
            yield start, row
            start, held = row, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def _clip(left: pa.Array, right: pa.Array, orders: int) -> np.ndarray:
    """Matrix (row, order) of the multiset intersection size of the two sides' n-grams."""
    sizes = np.concatenate([_lengths(left), _lengths(right)])
    tokens = pa.concat_arrays([left.flatten(), right.flatten()])
    word = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return _clip_numbers(word, sizes, len(left), orders)


def _clip_characters(left: pa.Array, right: pa.Array, orders: int) -> np.ndarray:
    """The same for the characters of two text columns: their code points are their numbers."""
    texts = pc.fill_null(pa.concat_arrays([left, right]), "")
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    return _clip_numbers(codes, pc.utf8_length(texts).to_numpy().astype(np.int64), len(left), orders)


def _clip_sorted(word: np.ndarray, sizes: np.ndarray, rows: int, orders: int) -> np.ndarray | None:
    """:func:`_clip_numbers` by one sort: row, the next ``orders`` numbers (0 past the text's end) and the side as one key.

    Its prefixes are the shorter grams, in order too. None when such a key exceeds 63 bits.
    """
    seen = np.unique(word)
    bits = len(seen).bit_length()
    if max(rows - 1, 0).bit_length() + orders * bits + 1 > 63:
        return None
    number = np.searchsorted(seen, word) + 1
    text = np.repeat(np.arange(2 * rows), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # tokens from here to the text's end
    key = text % rows
    for ahead in range(orders):
        key = key << bits
        fits = max(len(word) - ahead, 0)
        key[:fits] |= np.where(left[:fits] > ahead, number[ahead:], 0)
    key = np.sort(key << 1 | (text >= rows))
    result, side, key = np.zeros((rows, orders), np.int64), key & 1, key >> 1
    row = key >> orders * bits
    for order in range(1, orders + 1):
        gram = key >> (orders - order) * bits
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        of_right = np.add.reduceat(side, first)
        both = np.minimum(of_right, np.diff(np.r_[first, len(gram)]) - of_right)
        whole = gram[first] & (1 << bits) - 1 > 0
        result[:, order - 1] = np.bincount(row[first][whole], weights=both[whole], minlength=rows)
    return result


def _clip_numbers(word: np.ndarray, sizes: np.ndarray, rows: int, orders: int) -> np.ndarray:
    """``word``: the numbered tokens of the left texts, then of the right ones; ``sizes``: tokens of each text."""
    if len(word) and (result := _clip_sorted(word, sizes, rows, orders)) is not None:
        return result
    text = np.repeat(np.arange(2 * rows), sizes)
    base = int(word.max()) + 1 if len(word) else 1
    result = np.zeros((rows, orders), np.int64)
    start, gram = np.arange(len(word)), word
    for order in range(1, orders + 1):
        if order > 1:
            fits = start + order <= len(word)
            start, gram = start[fits], gram[fits]
            whole = text[start + order - 1] == text[start]
            start, gram = start[whole], gram[whole]
            # A gram is its prefix's dense number joined with the next word's number.
            gram = np.unique(gram * base + word[start + order - 1], return_inverse=True)[1]
        if not len(start):
            break
        key = (text[start] % rows) * (int(gram.max()) + 1) + gram
        distinct, place, both = np.unique(key, return_inverse=True, return_counts=True)
        of_left = np.bincount(place[text[start] < rows], minlength=len(distinct))
        row = distinct // (int(gram.max()) + 1)
        result[:, order - 1] = np.bincount(row, weights=np.minimum(of_left, both - of_left), minlength=rows)
    return result


def clipped_matches(left: Column | str, right: Column | str, orders: int = 4) -> Column:
    """``array<bigint>``: for n = 1..orders, how many n-grams the two token arrays share,
    each gram counted as often as in the side that has fewer of it."""

    return _clipped(left, right, orders, _lengths, _clip)


def clipped_character_matches(left: Column | str, right: Column | str, orders: int = 4) -> Column:
    """The same for the characters of two texts, which stay whole strings."""
    def sizes(texts: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    return _clipped(left, right, orders, sizes, _clip_characters)


def _clipped(left: Column | str, right: Column | str, orders: int, sizes: Callable, clip: Callable) -> Column:
    @F.arrow_udf("array<bigint>")
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        parts = [clip(a.slice(lo, hi - lo), b.slice(lo, hi - lo), orders) for lo, hi in _slices(sizes(a) + sizes(b))]
        flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.int64)
        offsets = np.arange(0, len(flat) + 1, orders, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return kernel(left, right)


def _alternated(lists: pa.Array, radius: int, glue: str) -> pa.Array:
    sizes, flat = _lengths(lists), lists.flatten()
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # tokens from here to the text's end
    grams, fits = [flat], left[:, None] > np.arange(radius + 1)
    for level in range(1, radius + 1):
        start = np.flatnonzero(fits[:, level])
        grams.append(pc.binary_join_element_wise(*[flat.take(pa.array(start + k)) for k in range(level + 1)], glue))
    # A gram's place among all: the grams of its level before it, after the levels below.
    place = np.cumsum(fits, axis=0) - 1 + np.cumsum([0, *map(len, grams[:-1])])
    words = pa.concat_arrays(grams).take(pa.array(place[fits]))
    known = words.is_valid().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), sizes).repeat(fits.sum(1))
    ends = np.cumsum(np.bincount(text[known], minlength=len(lists)))
    offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[lists.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, words.drop_null())


def alternated(tokens: Column | str, radius: int, glue: str) -> Column:
    """Of every place of a token array the grams of 1 to ``radius`` + 1 tokens that begin there; none with a null token."""

    @F.arrow_udf("array<string>")
    def kernel(lists: pa.Array) -> pa.Array:
        parts = [_alternated(lists.slice(lo, hi - lo), radius, glue) for lo, hi in _slices(_lengths(lists))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return kernel(tokens)


def alternated_rows(rows: DataFrame, row_id: str, radius: int, glue: str) -> DataFrame:
    """(row_id, kind ``alt``, words): :func:`alternated` of (row_id, token array), a bounded number of tokens at a time; rows without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(_lengths(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                part = part.filter(pa.array(_lengths(part.column(1)) > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["alt"] * len(part.column(0))), _alternated(part.column(1), radius, glue)], names=[row_id, "kind", "words"])

    fields = [T.StructField(row_id, rows.schema[row_id].dataType), T.StructField("kind", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer step per right token."""
    masks: dict[str, int] = {}
    for i, token in enumerate(a):
        masks[token] = masks.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_length(left: Column | str, right: Column | str) -> Column:
    """Longest common subsequence of two token arrays, in tokens."""

    @F.arrow_udf("bigint")
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for lo, hi in _slices(_lengths(a) + _lengths(b)):
            left, right = (side.slice(lo, hi - lo).to_pylist() for side in (a, b))
            found += [_lcs(x or [], y or []) for x, y in zip(left, right, strict=True)]
        return pa.array(found, pa.int64())

    return kernel(left, right)


def _match_keys(hyp_keys: list, ref_keys: list, hyp_free: list[int], ref_free: list[int]):
    """Pair the free places from the end: each word takes the last free place with its key."""
    last: dict[str, list[int]] = {}
    for j in ref_free:
        last.setdefault(ref_keys[j], []).append(j)
    pairs, left = [], []
    for i in reversed(hyp_free):
        places = last.get(hyp_keys[i])
        if places:
            pairs.append((i, places.pop()))
        else:
            left.append(i)
    taken = {j for _, j in pairs}
    return pairs, left[::-1], [j for j in ref_free if j not in taken]


def _match_synonyms(synonyms: list, ref: list, hyp_free: list[int], ref_free: list[int]):
    """As above with a set of acceptable words per place."""
    pairs = []
    ref_free = list(ref_free)
    for i in reversed(hyp_free):
        accepted = set(synonyms[i] or ())
        for at in range(len(ref_free) - 1, -1, -1):
            if ref[ref_free[at]] in accepted:
                pairs.append((i, ref_free.pop(at)))
                break
    return pairs


def _meteor(ref, hyp, ref_stem, hyp_stem, synonyms, alpha, beta, gamma) -> float:
    pairs, hyp_free, ref_free = _match_keys(hyp, ref, list(range(len(hyp))), list(range(len(ref))))
    if hyp_stem is not None and hyp_free and ref_free:
        more, hyp_free, ref_free = _match_keys(hyp_stem, ref_stem, hyp_free, ref_free)
        pairs += more
    if synonyms is not None and hyp_free and ref_free:
        pairs += _match_synonyms(synonyms, ref, hyp_free, ref_free)
    if not pairs:
        return 0.0
    pairs.sort()
    breaks = sum(1 for (i, j), (p, q) in zip(pairs, pairs[1:]) if p != i + 1 or q != j + 1)
    precision, recall = len(pairs) / len(hyp), len(pairs) / len(ref)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return (1 - gamma * ((1 + breaks) / len(pairs)) ** beta) * mean


def meteor(
    reference: Column | str,
    hypothesis: Column | str,
    stems: tuple[Column | str, Column | str] | None = None,
    synonyms: Column | str | None = None,
    alpha: float = 0.9,
    beta: float = 3.0,
    gamma: float = 0.5,
) -> Column:
    """METEOR of two token arrays, compared in lower case.

    ``stems``: the reference's and the hypothesis' stem arrays, aligned with their tokens.
    ``synonyms``: for each hypothesis token the array of words it may stand for.
    A stage without its argument does not run.
    """
    columns = [reference, hypothesis, *(stems or ()), *([synonyms] if synonyms is not None else [])]

    @F.arrow_udf("double")
    def kernel(*arrays: pa.Array) -> pa.Array:
        scores = []
        for lo, hi in _slices(sum(_lengths(a) for a in arrays)):
            for values in zip(*[a.slice(lo, hi - lo).to_pylist() for a in arrays], strict=True):
                rest = list(values[2:])
                ref_stem, hyp_stem = (rest.pop(0), rest.pop(0)) if stems else (None, None)
                ref, hyp = ([token.lower() for token in side or []] for side in values[:2])
                scores.append(_meteor(ref, hyp, ref_stem, hyp_stem,
                                      rest.pop(0) if rest else None, alpha, beta, gamma))
        return pa.array(scores, pa.float64())

    return kernel(*columns)


def wordpiece_tokenizer(vocabulary: list[str], unknown: str = "[UNK]") -> Callable[[Column], Column]:
    """Greedy longest-match sub-words of a word array, for a vocabulary the user loads.

    The vocabulary travels with the task, so it must be of fixed, small size
    (sub-word vocabularies have some ten thousand entries).
    """
    entries = frozenset(vocabulary)
    longest = max(map(len, entries), default=0)

    def pieces(word: str) -> list[str]:
        found, start = [], 0
        while start < len(word):
            mark = "##" if start else ""
            for end in range(min(len(word), start + longest), start, -1):
                if mark + word[start:end] in entries:
                    found.append(mark + word[start:end])
                    start = end
                    break
            else:
                return [unknown]
        return found

    @F.arrow_udf("array<string>")
    def kernel(lists: pa.Array) -> pa.Array:
        seen: dict[str, list[str]] = {}
        rows = []
        for tokens in lists.to_pylist():
            row = []
            for token in tokens or []:
                if token not in seen:
                    seen[token] = pieces(token)
                row += seen[token]
            rows.append(row)
        return pa.array(rows, pa.list_(pa.string()))

    return kernel
