"""Equality of whole texts by digest, so that texts stay where they are read.

Exchanges carry 32-byte SHA-256 digests and row ids. Two texts with one such digest are
not known to exist, so equal digests count as equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.joins import lookup_join
from pairloom.session import pinned


def digest(*columns: Column | str) -> Column:
    """32 bytes for the values together; null differs from the empty text, and the columns' borders count."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def distinct_rows(rows: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Of the rows equal in ``columns`` the one with the smallest ``row_id`` (distinct, not null)."""
    rows = pinned(rows)
    first = rows.select(digest(*columns).alias("_digest"), row_id).groupBy("_digest").agg(F.min(row_id).alias(row_id))
    return lookup_join(rows, first.select(row_id), row_id, "left_semi", spread_by=[row_id])


def without_texts(rows: DataFrame, seen: DataFrame, text: str, row_id: list[str]) -> DataFrame:
    """Rows whose ``text`` does not occur in ``seen``; a null text occurs nowhere. ``row_id`` tells the rows apart."""
    marks = rows.where(F.col(text).isNotNull()).select(*row_id, digest(text).alias("_digest"))
    known = pinned(seen.where(F.col(text).isNotNull()).select(digest(text).alias("_digest")).distinct())
    met = pinned(lookup_join(marks, known, "_digest", "left_semi", spread_by=row_id).select(*row_id))
    return lookup_join(rows, met, row_id, "left_anti", spread_by=row_id)
