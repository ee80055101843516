"""Column expressions for words of ASCII letters and digits and all characters beyond ASCII.

`lower` also folds letters beyond ASCII, which the word rules leave as they are, but it is much faster than a translation
of A-Z and leaves word boundaries in place. Candidates are therefore found in folded words, and decided in exact ones.
`lower` makes a capital sigma a final one by what stands around the word; `folded` has one form of it only, so that equal
words are equal when folded, wherever they stand."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def folded(text: Column) -> Column:
    """The text with letters of all alphabets in lower case; a word's form does not depend on its neighbours."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def split_words(lowered: Column) -> Column:
    """Pieces of a lower-cased text: its words, with an empty piece before a leading and after a trailing gap. An empty
    text is one empty piece."""
    return F.split(lowered, GAP)


def lead(pieces: Column) -> Column:
    """Number of empty pieces before the first word."""
    return F.when(pieces[0] == "", 1).otherwise(0)


def count_words(pieces: Column) -> Column:
    last = F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - lead(pieces) - last).cast("long")


def only_words(lowered: Column) -> Column:
    """The words of a lower-cased text, without empty pieces; cutting by gaps is faster where their places matter less."""
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
