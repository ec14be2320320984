"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from pairloom.llm import spelling


def edits(a, b):
    """Whether one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_words(rows, least_length=6, least_count=5, every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % every == 0:
                place = h % len(word)
                word = word[:place] + word[place + 1:]
            if len(word) >= least_length:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and counts[v] >= ratio * counts[w] else None for w, v in best.items()}
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(draw, size):
    """Random words of few letters, their permutations and their edits, with counts that chain."""
    words = {}
    while len(words) < size:
        word = "".join(draw.choice("abcdeé") for _ in range(draw.randrange(6, 11)))
        n = draw.choice([5, 6, 30, 160, 900])
        for _ in range(draw.randrange(6)):
            words.setdefault(word, n)
            place, kind = draw.randrange(len(word)), draw.randrange(4)
            letter = draw.choice("abcdezÿ")
            word = [word[:place] + word[place + 1:], word[:place] + letter + word[place:], word[:place] + letter + word[place + 1:], word[place:] + word[:place]][kind]
            n = max(5, n // draw.choice([1, 4, 5, 6]))
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize(("leaf", "block", "sample"), [(16, 5, 1 << 18), (8, 4096, 100), (512, 4096, 1 << 18)])
def test_variants_equal_all_pairs(spark, monkeypatch, leaf, block, sample):
    draw = random.Random(leaf)
    counts = vocabulary(draw, 500)
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    pairs = [(r.word, r.near, r.near_n) for r in spelling.near_pairs(frame, leaf, block, sample).collect()]
    assert sorted(pairs) == sorted((a, b, counts[b]) for a in counts for b in counts if edits(a, b))
    if leaf == 512:
        rows = got(spelling.variants(frame))
        assert rows == brute_variants(counts)
        assert any(r[1] is not None and r[2] != r[1] for r in rows)  # chains of forms


def test_permutations_share_letter_counts(spark):
    draw, words = random.Random(4), set()
    while len(words) < 300:
        letters = list("aabbccdd")
        draw.shuffle(letters)
        words.add("".join(letters))
    words |= {w[:-1] + "e" for w in list(words)[:100]} | {w + "a" for w in list(words)[:100]}
    frame = spark.createDataFrame([(w, 7) for w in words], "word string, n bigint")
    pairs = sorted((r.word, r.near) for r in spelling.near_pairs(frame, 16, 50).collect())
    assert pairs == sorted((a, b) for a in words for b in words if edits(a, b))


def test_whole_texts(spark):
    draw = random.Random(5)
    stems = ["Language", "language", "langage", "longuage", "München", "MÜNCHEN", "éclairage", "éclairages", "a×b÷cdef", "tiny", "Straße", "Strasse", "naïveté"]
    rows = [(i, " ".join(draw.choice(stems) + draw.choice(["", ".", "-x", "7", "中"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "language " * 9), (None, None), (70, ""), (71, None), (72, "x" * 5), rows[0], rows[0], (73, "verylong" * 20_000), (74, ("verylong" * 20_000 + " ") * 6)]
    frame = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id bigint, text string, word string, n bigint, key int").repartition(4)
    want = brute_words(rows, every=7)
    assert {r.word: r.n for r in spelling.word_counts(frame, every=7).collect()} == want
    short = [(i, t) for i, t in rows if i not in (73, 74)]
    frame = frame.where("doc_id is null or doc_id not in (73, 74)")
    assert got(spelling.spelling_variants(frame, every=7)) == brute_variants(brute_words(short, every=7))
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_very_long_words(spark):
    words = {"ab" * 30_000: 50, "ab" * 29_999 + "a": 5, "ab" * 29_999 + "az": 6, "z" * 60_000: 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling.variants(frame)) == brute_variants(words)
