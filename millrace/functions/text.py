"""Column expressions for cleaning and tokenising text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Fixed value: the characters removed before words are counted.
PUNCTUATION_AND_DIGITS = r"[,.!%()+'\d:-]"


def split_trim(col: Column, sep: str) -> Column:
    """Trim, then split on a literal separator."""
    return F.split(F.trim(col), re.escape(sep), -1)


def remove_names(col: Column, names) -> Column:
    """Delete literal names in the given order; null and '' both give null."""
    def cleared(text):
        for name in names:
            text = F.replace(text, F.lit(name), F.lit(""))
        return text

    return let(col, lambda c: F.when(F.length(c) > 0, cleared(c)))


def null_if_contains(col: Column, needle: str) -> Column:
    """Null when the text holds the needle; '' also gives null."""
    return let(col, lambda c: F.when((F.length(c) > 0) & ~F.contains(c, F.lit(needle)), c))


def normalized(col: Column) -> Column:
    """Null becomes '', everything lower case."""
    return F.lower(F.coalesce(col, F.lit("")))


def strip_chars(col: Column, pattern: str = PUNCTUATION_AND_DIGITS) -> Column:
    return F.regexp_replace(col, pattern, "")


def tokens(col: Column, sep: str = " ") -> Column:
    """Split on a single separator, empty pieces dropped."""
    return F.filter(F.split(col, re.escape(sep), -1), lambda w: w != "")


def without_words(col: Column, words) -> Column:
    """The text's whitespace-separated words that are not in the list, joined by one space."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " "), lambda w: ~w.isin(list(words)) & (w != ""))
    return F.array_join(kept, " ")


def first_field(arr: Column, field: str) -> Column:
    """A field of the first struct of an array; null for an empty array."""
    return F.try_element_at(arr, F.lit(1))[field]


def idf(doc_count: Column, n_docs) -> Column:
    """ln((N + 1) / n + 1) + 1."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((n + 1) / doc_count + 1) + 1
