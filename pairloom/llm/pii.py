"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four base patterns (email, ip, card, phone). Their words to
the left and right are lexical patterns; identifier-like strings found in the same
contexts are instances. Patterns and instances form a graph whose scores Spark
refines in rounds: a pattern is as good as the instances it holds, an unknown
instance as good as its patterns. Good patterns discover identifiers that no base
pattern covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pinned, whole_row
from pairloom.operators.joins import lookup_join

KINDS = ("email", "ip", "card", "phone")

# The contract's expressions in a form that needs no backtracking: possessive
# repetition, and a start only where a run of its characters begins or the last match
# ended (\G). They find the same matches in time linear in the text.
_FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A run of letters and digits with inner separators that holds a digit.
_CANDIDATE = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z@._+/-]*+[0-9])[A-Za-z0-9]++(?:[@._+/-]++[A-Za-z0-9]++)*+"
# Letters and digits that a discovered identifier has at least; shorter runs are numbers of any kind.
LEAST_CHARS = 6
_CHUNK = 256
_CONTEXT = 60


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row; inside a function over an array it would be evaluated once an element."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The values before each place of an array joined to one, in chunks, so that long arrays stay far from quadratic work."""
    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, join)

    def within(every: Column) -> Column:
        starts = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(starts, lambda k: fold(F.slice(every, k * _CHUNK + 1, F.lit(_CHUNK))))

        def placed(heads: Column) -> Column:
            return F.transform(every, lambda _, i: join(
                F.get(heads, F.floor(i / _CHUNK).cast("int")), fold(F.slice(every, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))

        return _bound(chunks, lambda c: _bound(F.transform(c, lambda _, k: fold(F.slice(c, F.lit(1), k))), placed))

    return _bound(values, within)


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _sooner(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _before(lengths: Column) -> Column:
    """Running sums of an array before each place."""
    return _running(lengths, F.lit(0), lambda a, x: a + x)


def _occurrences(df: DataFrame, text: str, pattern: str, out: str, least: int = 0) -> DataFrame:
    """Adds array ``out`` of (start, end, value, left, right): the matches, in code points, with their surroundings."""
    found, between, at = f"_{out}_m", f"_{out}_s", f"_{out}_p"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    gaps = F.transform(F.col(found), lambda m, i: F.length(F.col(between)[i]) + F.length(m))
    df = df.withColumn(at, F.when(F.size(found) > 0, _before(gaps)))
    spans = F.transform(F.col(found), lambda m, i: F.struct(
        (F.col(at)[i] + F.length(F.col(between)[i])).cast("int").alias("start"),
        (F.col(at)[i] + F.length(F.col(between)[i]) + F.length(m)).cast("int").alias("end"),
        m.alias("value"), F.substring(F.col(between)[i], -_CONTEXT, _CONTEXT).alias("left"), F.substring(F.col(between)[i + 1], 1, _CONTEXT).alias("right"),
    ))
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return df.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(F.filter(spans, lambda s: F.lit(False)))).drop(found, between, at)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda n, i: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n))
    return F.aggregate(doubled, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.(?=.)|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array column ``_email``, ``_ip``, ``_card``, ``_phone`` each, of (start, end, value, left, right)."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        df = _occurrences(df, "_text", _FIND[kind], f"_{kind}")
        df = df.withColumn(f"_{kind}", _filtered(kind))
    return df


def _filtered(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: _valid(kind, s["value"]))


def _marked(column: str | Column, number: int) -> Column:
    return F.transform(column, lambda s: F.struct(F.lit(number).alias("kind"), s.alias("s")))


def _places(column: str, number: int) -> Column:
    return F.transform(column, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _context(side: Column, pattern: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(side, pattern, 0)), "[0-9]", "0")


def _patterns(df: DataFrame) -> DataFrame:
    """One row per occurrence and lexical pattern: the two words before it, and the word before with the word after it."""
    two = _context(F.col("s.left"), r"(?U)(?:\w++[^\w]{1,3}+)?\w++[^\w]{0,6}+$")
    one = _context(F.col("s.left"), r"(?U)\w++[^\w]{0,6}+$")
    after = _context(F.col("s.right"), r"(?U)^[^\w]{0,6}+\w++")
    made = F.array(F.concat(F.lit("l:"), two), F.concat(F.lit("b:"), one, F.lit("|"), after))
    usable = F.filter(made, lambda p: ~p.isin("l:", "b:|"))
    return df.select("*", F.explode(usable).alias("pattern"))


def _apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` that overlap none of ``base``: both in one order by start, with the farthest end before and the next start behind each."""
    mark = lambda spans, t: F.transform(spans, lambda s: F.struct(s["start"].alias("p"), F.lit(t).alias("t"), s["end"].alias("e"), s.alias("s")))
    far = F.lit((1 << 31) - 1)

    def kept(every: Column) -> Column:
        ends = _running(F.transform(every, lambda x: F.when(x["t"] == 0, x["e"]).otherwise(0)), F.lit(0), _later)
        starts = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(x["t"] == 0, x["p"]).otherwise(far))), far, _sooner))
        return _bound(ends, lambda a: _bound(starts, lambda b: F.transform(
            F.filter(every, lambda x, i: (x["t"] == 1) & (F.get(a, i) <= x["p"]) & (F.get(b, i) >= x["e"])), lambda x: x["s"])))

    return F.when(F.size(found) == 0, found).otherwise(_bound(F.array_sort(F.concat(mark(base, 0), mark(found, 1))), kept))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """The rows as struct ``row``, so that no column name can clash, with ``text_md5``, the ``base`` spans, and ``seen``:
    (kind, span) of every base span and of every candidate beside them. Written once: each text is scanned once."""
    df = with_base_spans(docs.select(whole_row(docs), F.col(f"`{text}`").alias("text")))
    df = _occurrences(df, "_text", _CANDIDATE, "_other", least=LEAST_CHARS)
    base = F.concat(*[_places(f"_{k}", n) for n, k in enumerate(KINDS)])
    apart = _apart(F.col("_other"), F.concat(*[F.col(f"_{k}") for k in KINDS]))
    seen = F.concat(*[_marked(f"_{k}", n) for n, k in enumerate(KINDS)], _marked(apart, -1))
    return pinned(df.select("row", F.md5("_text").alias("text_md5"), base.alias("base"), seen.alias("seen")))


def discovered(docs: DataFrame, rounds: int = 3, least: int = 3, good: float = 0.8, text: str = "text") -> DataFrame:
    """``text_md5`` and ``found``, an array of (kind, start, end), for each text in which patterns discover identifiers.

    A pattern counts from ``least`` different known identifiers of a kind on, and
    discovers from score ``good`` on. Copies of a text count once. Scores, not texts,
    move in the rounds; each round is written to the shared folder.
    """
    return _discovered(_scanned(docs, text), rounds, least, good)


def _discovered(scanned: DataFrame, rounds: int, least: int, good: float) -> DataFrame:
    rows = scanned.select("text_md5", F.explode("seen").alias("x")).select("text_md5", "x.kind", "x.s")
    seen = pinned(_patterns(rows).select("text_md5", "kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lower("s.value").alias("value"), "pattern"))
    edges = pinned(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    score = edges.where("kind >= 0").groupBy("value").agg(F.max("kind").alias("of")).select("value", "of", F.lit(1.0).alias("score"))
    known = pinned(score)
    patterns = None
    for _ in range(rounds):
        held = edges.join(known, "value", "left").select("pattern", "value", "of", "score")
        sizes = held.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
        support = held.where("of is not null").groupBy("pattern", "of").agg(F.sum("score").alias("mass"), F.sum(F.when(F.col("score") >= 1, 1).otherwise(0)).alias("seeds"))
        # A pattern holds as many seeds as it needs to be trusted; one missing vote is added to its instances.
        patterns = pinned(support.where(F.col("seeds") >= least).join(sizes, "pattern").select("pattern", "of", (F.col("mass") / (F.col("n") + 1)).alias("p")))
        votes = edges.where("kind < 0").select("pattern", "value").join(patterns, "pattern")
        fresh = votes.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("score"))
        best = fresh.groupBy("value").agg(F.max_by("of", F.struct("score", -F.col("of"))).alias("of"), F.max("score").alias("score"))
        seeds = known.where("score >= 1")
        known = pinned(seeds.unionByName(best.join(seeds.select("value"), "value", "left_anti")))
    trusted = patterns.where(F.col("p") >= good).groupBy("pattern").agg(F.max_by("of", F.struct("p", -F.col("of"))).alias("of"))
    open_rows = seen.where("kind < 0")
    by_pattern = lookup_join(open_rows, trusted, "pattern", spread_by=["text_md5", "start"]).select("text_md5", "start", "end", "of")
    return by_pattern.groupBy("text_md5", "start", "end").agg(F.min("of").alias("of")).groupBy("text_md5").agg(
        F.sort_array(F.collect_list(F.struct(F.col("of").alias("kind"), "start", "end"))).alias("found"))


def _spans_of(docs: DataFrame, rounds: int, least: int, good: float, text: str) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with ``text``, ``base`` and ``spans``."""
    scanned = _scanned(docs, text)
    new = pinned(_discovered(scanned, rounds, least, good))
    found = lookup_join(scanned.drop("seen"), new, "text_md5", "left", spread_by=["row"])
    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found")))
    return found.select("row", F.col(f"row.`{text}`").alias("text"), "base", spans.alias("spans"))


def find_pii(docs: DataFrame, rounds: int = 3, least: int = 3, good: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind number, start, end) in order, in code points, end exclusive.

    ``base`` holds the base patterns' valid matches, ``spans`` those and the discovered
    ones. Null and empty texts have none. Every row of ``docs`` stays, with all its
    columns but any named ``base`` or ``spans``; repeated rows repeat; an empty table
    gives an empty result.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("base", "spans")]
    return _spans_of(docs, rounds, least, good, text).select(*kept, "base", "spans")


def of_kind(spans: str, number: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == number)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", rounds: int = 3, least: int = 3, good: float = 0.8) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, as in ``[EMAIL]``.

    Of overlapping spans the later gives way, but all their text goes. Other columns
    stay, whatever their names; a null text stays null.
    """
    df = _spans_of(docs, rounds, least, good, text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn("ordered", ordered)
    before = _running(F.transform("ordered", lambda s: s["end"]), F.lit(0), _later)
    earlier = _bound(before, lambda far: F.transform("ordered", lambda s, i: F.struct(F.greatest(s["start"], F.get(far, i)).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn("clear", F.filter(earlier, lambda s: s["start"] < s["end"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        last = F.when(i > 0, F.get("clear", i - 1)["end"]).otherwise(0)
        return F.concat(F.substring("text", last + 1, s["start"] - last), names[s["kind"]])

    rest = F.substring("text", F.element_at("clear", -1)["end"] + 1, F.length("text"))
    masked = F.when(F.size("clear") > 0, F.concat(F.array_join(F.transform("clear", piece), ""), rest)).otherwise(F.col("text"))
    return df.select(*[masked.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
