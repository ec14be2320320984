"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding turns look-alike letters and digit substitutions into plain letters. The
lexicon's entries are word beginnings or whole words whose presence tells toxic rows
from others; they are learned from a bounded sample of labelled rows, one after
another, each on the rows that no earlier entry explains, so that the other words of
a copied toxic text get no weight. Phrases around an entry that only other rows use
are exceptions: an entry inside one does not count. The summed weight and the length
give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
_ALIKE = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl кk мm тt вb нh гr ьb "
    "αa οo ρp νv ιi κk τt υu χx εe "
    "ɑa ɡg ıi ʟl ɩi ᴀa ᴄc ᴅd ᴇe ᴊj ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz "
    "0o 1i 3e 4a 5s 7t @a"
)
FOLD = {ord(p[0]): p[1] for p in _ALIKE.split()} | {code + 0xFEE0: chr(code) for code in range(ord("a"), ord("z") + 1)}
_WORD = re.compile(r"[^\W_]+")
_SHORTEST, _LONGEST = 4, 12


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def _features(text: str) -> set[str]:
    """Beginnings of the folded text's words; a word too short for one ends in a space."""
    words = set(_WORD.findall(fold(text)))
    return {w[:n] for w in words for n in range(_SHORTEST, min(len(w), _LONGEST) + 1)} | {w + " " for w in words if 1 < len(w) < _SHORTEST}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry.rstrip(" "), (len(entry.rstrip(" ")), weight, entry.endswith(" "), entry))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), None, False, phrase))
        if len(found):
            found.make_automaton()
        return found


def _matches(automaton, text: str) -> list[tuple[int, int, float, str]]:
    """Start, end, weight and entry of each match that counts: the heaviest at each word, none inside an exception."""
    if not len(automaton):
        return []
    folded = fold(text)
    best: dict[int, tuple[int, float, str]] = {}
    covered = []
    for last, (size, weight, whole, entry) in automaton.iter(folded):
        start, end = last + 1 - size, last + 1
        if start and folded[start - 1].isalnum():
            continue
        if weight is None:
            covered.append((start, end))
        elif not (whole and end < len(folded) and folded[end].isalnum()) and (start not in best or weight > best[start][1]):
            best[start] = (end, weight, entry)
    return [(s, e, w, t) for s, (e, w, t) in sorted(best.items()) if not any(a <= s and e <= b for a, b in covered)]


def _curve_input(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The curve's variables: summed weight, and the same per hundred words of length, both damped."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _gain(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """Likelihood-ratio statistic of presence against class, for features that lean towards the positive class."""
    pos, neg = np.asarray(pos, float), np.asarray(neg, float)
    total, rate = all_pos + all_neg, all_pos / max(all_pos + all_neg, 1)
    out = np.zeros(len(pos))
    for seen, of in ((pos, all_pos), (neg, all_neg)):
        expected = (pos + neg) * of / total
        for count, mean in ((seen, expected), (of - seen, of - expected)):
            out += np.where(count > 0, 2 * count * np.log(np.maximum(count, 1e-9) / np.maximum(mean, 1e-9)), 0)
    return np.where(pos > (pos + neg) * rate, out, 0)


def held_out(key: Column) -> Column:
    """Whether a row belongs to the fold that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _distinct(rows: DataFrame) -> DataFrame:
    """One of the near copies of a class: rows that share the smallest hash of their five-word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            smallest = []
            for value in first_column(part, "text").to_pylist():
                words = _WORD.findall(value.lower())
                shingles = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
                smallest.append(min(map(xxhash.xxh3_64_intdigest, shingles)) >> 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(smallest, pa.int64())], names=[*part.schema.names, "sketch"])

    marked = rows.mapInArrow(tidied(run), T.StructType([*rows.schema.fields, T.StructField("sketch", T.LongType())]))
    picked = marked.groupBy("sketch", "y").agg(F.min_by(F.struct("key", "text"), F.struct("key", F.xxhash64("text"))).alias("row"))
    return picked.select("row.key", "row.text", "y")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 10_000, candidates: int = 4_000, least_rows: int = 3, least_gain: float = 20.0,
    key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Lexicon:
    """The lexicon learned from at most ``sample`` labelled rows outside the held-out fold.

    The rows are those with the smallest hash of their key, the same at every layout.
    Near copies count once. ``candidates`` bounds the beginnings looked at closely, strongest first;
    an entry needs ``least_rows`` rows and a statistic of ``least_gain``. Null keys, null
    labels and labels without a document teach nothing; of several labels of one key the
    largest counts; without both classes the lexicon is empty and every score low.
    """
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("key")).agg(F.max((labels[label] > 0).cast("int")).alias("y"))
    drawn = known.where(~held_out(F.col("key"))).orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = pinned(_distinct(texts.join(F.broadcast(drawn), "key").select("key", "text", "y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (seen[1], seen[0])]]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "pos", "neg"])

        for part in text_slices(batches):
            for value, y in zip(first_column(part, "text").to_pylist(), first_column(part, "y").to_pylist(), strict=True):
                seen[y].update(_features(value))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
                seen = (Counter(), Counter())
        yield out()

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all_pos, all_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not all_pos or not all_neg:
        return Lexicon(curve=(math.log((all_pos + 1) / (all_neg + 9)), 0.0, 0.0))
    counts = rows.mapInArrow(tidied(count), "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = all_pos / (all_pos + all_neg)
    # Precision at least halfway from the base rate to one.
    strong = counts.where((F.col("pos") >= least_rows) & (F.col("pos") > (1 + rate) / 2 * (F.col("pos") + F.col("neg"))))
    value = F.col("pos") * F.log(F.col("pos") / (F.col("pos") + F.col("neg")) / rate)
    top = [r["feature"] for r in strong.orderBy(value.desc(), "feature").limit(candidates).collect()]
    number = {f: i for i, f in enumerate(top)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [sorted(number[f] for f in _features(t) if f in number) for t in first_column(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([first_column(part, "y"), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    # At most ``sample`` rows of small numbers.
    marked = rows.mapInArrow(tidied(incidence), "y int, found array<int>").where("size(found) > 0").collect()
    of_feature: list[list[int]] = [[] for _ in top]
    for i, r in enumerate(marked):
        for f in r["found"]:
            of_feature[f].append(i)
    toxic = np.array([r["y"] for r in marked], bool)
    groups = [np.array(g, np.int64) for g in of_feature]
    first_pos = np.array([toxic[g].sum() for g in groups])
    neg = np.array([len(g) for g in groups]) - first_pos
    open_rows, weights = toxic.copy(), {}
    pos, left = first_pos.copy(), all_pos
    while left and len(top):
        gain = _gain(pos, neg, left, all_neg)
        gain[pos < least_rows] = 0
        best = max(range(len(top)), key=lambda i: (round(float(gain[i]), 6), len(top[i]), top[i]))
        if gain[best] < least_gain:
            break
        weights[top[best]] = math.log((first_pos[best] + 0.5) / (all_pos + 1)) - math.log((neg[best] + 0.5) / (all_neg + 1))
        taken = groups[best][open_rows[groups[best]]]
        open_rows[taken] = False
        left -= len(taken)
        for i in taken:
            for f in marked[i]["found"]:
                pos[f] -= 1
    # Entries that many different rows share count too where others explain those rows.
    whole = _gain(first_pos, neg, all_pos, all_neg) if len(top) else []
    for i in sorted(range(len(top)), key=lambda i: (-round(float(whole[i]), 6), -len(top[i]), top[i])):
        common = first_pos[i] >= max(least_rows, 0.05 * all_pos) and 20 * neg[i] <= first_pos[i] and whole[i] >= least_gain
        if common and not any(top[i].startswith(t) or t.startswith(top[i]) for t in weights):
            weights[top[i]] = math.log((first_pos[i] + 0.5) / (all_pos + 1)) - math.log((neg[i] + 0.5) / (all_neg + 1))
    lexicon = Lexicon({t: w for t, w in weights.items() if w > 0})
    lexicon.exceptions = _exceptions(rows, lexicon, least_rows)
    scored = _evidence(rows.withColumnRenamed("key", "id"), lexicon, ["y"]).select("y", "weight", "n_words").collect()
    y = np.array([r["y"] for r in scored], float)
    x = _curve_input(np.array([r["weight"] for r in scored], float), np.array([r["n_words"] for r in scored], float))
    lexicon.curve = tuple(float(v) for v in _logistic(x, y))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _exceptions(rows: DataFrame, lexicon: Lexicon, least_rows: int) -> list[str]:
    """Two-word phrases around an entry that rows of the other class use and toxic rows do not."""
    if not lexicon.weights:
        return []

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in text_slices(batches):
            found, classes = [], []
            for value, y in zip(first_column(part, "text").to_pylist(), first_column(part, "y").to_pylist(), strict=True):
                folded = fold(value)
                around = set()
                for start, end, _, _ in _matches(automaton, value):
                    word = _WORD.match(folded, start)
                    before = re.search(r"([^\W_]+) \Z", folded[max(0, start - 40):start])
                    after = re.match(r" ([^\W_]+)", folded[word.end():word.end() + 40])
                    around |= {before[1] + " " + word[0]} if before else set()
                    around |= {word[0] + " " + after[1]} if after else set()
                found += around
                classes += [y] * len(around)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(classes, pa.int32())], names=["phrase", "y"])

    counts = rows.mapInArrow(tidied(phrases), "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    # At most one phrase per two rows of the bounded sample.
    return [r["phrase"] for r in counts.where((F.col("n") >= least_rows) & (F.col("pos") * 10 <= F.col("n"))).orderBy("phrase").collect()]


def _evidence(rows: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """``id``, ``kept`` columns, summed ``weight``, ``n_words`` and matched ``terms`` of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in text_slices(batches):
            texts = [t or "" for t in first_column(part, "text").to_pylist()]
            found = [_matches(automaton, t) for t in texts]
            columns = [first_column(part, c) for c in ("id", *kept)] + [
                pa.array([math.fsum(m[2] for m in f) for f in found], pa.float64()),
                pa.array([len(t.split()) for t in texts], pa.int64()),
                pa.array([[m[3].rstrip(" ") for m in f] for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *kept, "weight", "n_words", "terms"])

    fields = [rows.schema[c] for c in ("id", *kept)]
    schema = T.StructType([*fields, T.StructField("weight", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    return rows.select("id", "text", *kept).mapInArrow(tidied(run), schema)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1) and the matched ``terms`` of each whole text.

    A null or empty text has no match and gets the score of one without a match.
    Repeated rows repeat; null keys stay null; other columns are ignored, whatever
    their names; an empty table gives an empty result. No shuffle; the lexicon is
    bounded by the candidates of ``fit``.
    """
    found = _evidence(docs.select(docs[key].alias("id"), docs[text].alias("text")), lexicon, [])
    a, b, c = lexicon.curve
    per_length = 100 * F.col("weight") / F.greatest(F.col("n_words"), F.lit(1))
    line = F.lit(a) + F.lit(b) * F.log1p("weight") + F.lit(c) * F.log1p(per_length)
    return found.select(F.col("id").alias(key), (1 / (1 + F.exp(-line))).alias("score"), "terms")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay as they are, whatever their names."""
    lexicon = fit(docs, labels, key=key, text=text)
    a, b, c = lexicon.curve
    names = [f"c{i}" for i in range(len(docs.columns))]
    of_text = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in text_slices(batches, of_text):
            keep = []
            for value in first_column(part, of_text).to_pylist():
                weight = math.fsum(m[2] for m in _matches(automaton, value or ""))
                words = max(len((value or "").split()), 1)
                line = a + b * math.log1p(weight) + c * math.log1p(100 * weight / words)
                keep.append(1 / (1 + math.exp(-min(max(line, -700), 700))) < threshold)
            yield part.filter(pa.array(keep))

    # Plain names on the way: a table function takes no column with a dot in its name.
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kept = plain.mapInArrow(tidied(run), plain.schema)
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
