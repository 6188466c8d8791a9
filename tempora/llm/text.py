"""Column expressions for words and for keys of texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text; NULL counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(7), F.length(t), t)]
