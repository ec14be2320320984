"""Tokens, markers and clean-up of generated text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data formats.
MOL2CAP = "mol2cap:"
CAP2MOL = "cap2mol:"
LEADING_MARK = "[CLS] "
SPECIAL_TOKENS = ("[PAD]", "[CLS]", "[SEP]")
PATH_SEPARATOR = "__"
MAX_TEXT_TOKENS = 512
MAX_EMBEDDING_TOKENS = 256
MAX_PAIR_TOKENS = 900

_WORD = r"[\p{L}\p{N}]++|[^\s]"
# Every character a Unicode-aware strip removes.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop all edge whitespace, not only spaces."""
    return F.btrim(_col(c), F.lit(_WHITESPACE))


def task_of(source: Column | str) -> Column:
    """Task named by the marker inside the text; the first marker kind wins, NULL without one."""
    source = _col(source)
    return (
        F.when(F.contains(source, F.lit(MOL2CAP)), F.lit("mol2cap"))
        .when(F.contains(source, F.lit(CAP2MOL)), F.lit("cap2mol"))
    )


def unmarked(source: Column | str) -> Column:
    """The text without any occurrence of its own task's marker, edges stripped."""
    source = _col(source)
    marker = F.concat(task_of(source), F.lit(":"))
    return strip(F.replace(source, marker, F.lit("")))


def words(c: Column | str, lower: bool = True) -> Column:
    """Runs of letters and digits, and every other visible character alone."""
    c = _col(c)
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(_WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Number of :func:`words`, counted without building them."""
    return F.regexp_count(_col(c), F.lit(_WORD))


def alnum_words(c: Column | str) -> Column:
    """Lower-cased runs of ``[a-z0-9]``: the token rule of the ROUGE metric."""
    return F.filter(F.split(F.lower(_col(c)), "[^a-z0-9]+"), lambda t: t != "")


def characters(c: Column | str) -> Column:
    """Single characters; the empty text has none."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def spaced_words(c: Column | str) -> Column:
    """Split on whitespace, as a corpus line is read."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: t != "")


def truncated(tokens: Column | str, max_tokens: int | None) -> Column:
    """The first ``max_tokens`` tokens; ``None`` keeps all."""
    tokens = _col(tokens)
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def without_special(tokens: Column | str, special: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.isin(*special))


def without_leading_mark(c: Column | str) -> Column:
    """Drop one ``[CLS] `` at the very start."""
    return F.regexp_replace(_col(c), r"^\[CLS\] ", "")


def unlisted(c: Column | str) -> Column:
    """Undo the printed form of a one-element list; any other text passes through."""
    c = _col(c)
    inner = F.coalesce(
        F.nullif(F.regexp_extract(c, r"(?s)^\['(.*)'\]$", 1), F.lit("")),
        F.regexp_extract(c, r'(?s)^\["(.*)"\]$', 1),
    )
    plain = inner
    for escape, value in ((r"\\", "\0"), (r"\n", "\n"), (r"\t", "\t"), (r"\r", "\r"), (r"\'", "'"), ("\0", "\\")):
        plain = F.replace(plain, F.lit(escape), F.lit(value))
    return F.when(c.rlike(r"""(?s)^\[('.*'|".*")\]$"""), plain).otherwise(c)


def _without(c: Column, parts: tuple[str, ...]) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


def cleaned(c: Column | str, strip_hash: bool = False) -> Column:
    """List brackets and literal ``\\n`` removed; ``#`` only on request, since it is a bond sign."""
    parts = ("['", "']", "#", "\\n") if strip_hash else ("['", "']", "\\n")
    return _without(_col(c), parts)


def cleaned_first_word(c: Column | str) -> Column:
    """As :func:`cleaned`, without the word ``assistant``, then the first space-separated word."""
    return F.split_part(strip(_without(_col(c), ("['", "']", "\\n", "assistant"))), F.lit(" "), F.lit(1))


def segments(path: Column | str) -> Column:
    """The group names and the leaf of a ``a__b__leaf`` path, as an array."""
    return F.split(_col(path), PATH_SEPARATOR)


def last_segment(path: Column | str) -> Column:
    """Lower-cased leaf name of a ``a__b__leaf`` path."""
    return F.lower(F.element_at(segments(path), -1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def contains_phrase(phrase_tokens: Column | str, text_tokens: Column | str) -> Column:
    """Row form of contiguous containment; the empty phrase is in every text."""
    mark = F.lit(" ")
    inside = F.concat(mark, F.array_join(_col(text_tokens), " "), mark)
    phrase = F.concat(mark, F.array_join(_col(phrase_tokens), " "), mark)
    return (F.size(_col(phrase_tokens)) == 0) | F.contains(inside, phrase)


def padded(ids: Column | str, length: int, pad_id: int) -> Column:
    """Exactly ``length`` ids: cut, or filled up with ``pad_id`` on the right."""
    kept = F.slice(_col(ids), 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id).cast("int"), length - F.size(kept)))


def attention(ids: Column | str, length: int) -> Column:
    """1 for each kept id, 0 for each padding place."""
    kept = F.least(F.size(_col(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), length - kept))
