"""Text expressions: normal forms, keys and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\f\r"
_SPACE = r"[ \t\n\x0B\f\r]+"


def normal(text: Column) -> Column:
    """Trimmed, outer double quotes off, every run of white space one space."""
    bare = F.btrim(F.btrim(text, F.lit(_WHITE)), F.lit('"'))
    return F.trim(F.regexp_replace(bare, _SPACE, " "))


def key(text: Column) -> Column:
    """What equal texts have in common: lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, _SPACE, " ")))


def words(text: Column) -> Column:
    """Number of space-separated words of a normal text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)


def phrase(text: Column, most_words: int = 6, most_chars: int = 48) -> Column:
    """A short phrase in normal form, or null: lower case, _ as space, outer punctuation off; one to six words, not
    too long, and not mostly the same word again."""
    p = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), _SPACE, " "))
    p = F.btrim(p, F.lit(" .,:;/-"))
    w = F.split(p, " ")
    repeats = (F.size(w) > 3) & (F.size(F.array_distinct(w)) <= F.greatest(F.lit(1), F.floor(F.size(w) / 3)))
    return F.when((p != "") & (F.size(w) <= most_words) & (F.length(p) <= most_chars) & ~repeats, p)
