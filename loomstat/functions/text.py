"""Text expressions. All are JVM-side Columns over whole strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\r\\f]+"

# The English stop words of the standard text analyzer.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()


def tokens(text: Column) -> Column:
    """Blank-separated tokens, none empty."""
    return F.array_remove(F.split(text, BLANKS), "")


def normalise_word(word: Column) -> Column:
    """Strip ASCII punctuation and lower-case."""
    return F.lower(F.regexp_replace(word, r"\p{Punct}", ""))


def normalised_tokens(text: Column) -> Column:
    """All normalised words of a text, none empty.

    Punctuation goes from the whole text in one pass; splitting afterwards gives
    the same words as treating them one by one.
    """
    return tokens(F.lower(F.regexp_replace(text, r"\p{Punct}", "")))


def strip_unicode_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, r"\p{P}", "")


def strip_pos(word: Column) -> Column:
    """Drop a part-of-speech suffix: keep what stands before the first ``_``."""
    return F.substring_index(word, "_", 1)


def query_terms(text: Column) -> Column:
    """Distinct lower-cased terms of a phrase, split at single blanks."""
    return F.array_distinct(F.split(F.lower(text), " "))


def analyzed_words(text: Column) -> Column:
    """Lower-cased letter/digit runs, joined across one inner apostrophe or full stop."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:['.][\p{L}\p{N}]+)*"), F.lit(0))


def analyzed_tokens(text: Column, stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS)) -> Column:
    """Analyzed words without stop words, repeats kept; approximates a standard analyzer."""
    return F.filter(analyzed_words(text), lambda w: ~w.isin(list(stop_words)))


def shingles(words: Column, n_max: int, n_min: int = 1) -> Column:
    """All runs of ``n_min``..``n_max`` neighbouring words, joined by a blank."""
    size = F.size(words)

    def runs(n: int) -> Column:
        last = size - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))

    parts = [runs(n) for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def longest_runs(words: Column, n_max: int, n_min: int = 1) -> Column:
    """The longest run of up to ``n_max`` words from each position that has ``n_min``; its beginnings are the other ``shingles``."""
    last = F.size(words) - (n_min - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n_max))))


def head_of(ngram: Column) -> Column:
    """Everything before the last blank."""
    return F.left(ngram, F.length(ngram) - F.length(tail_of(ngram)) - 1)


def tail_of(ngram: Column) -> Column:
    """Everything after the last blank."""
    return F.substring_index(ngram, " ", -1)


def short_host(name: Column) -> Column:
    """Host name without its domain."""
    return F.substring_index(name, ".", 1)


def contains_literal(text: Column, needle: str) -> Column:
    """True when the line holds ``needle`` as is (no pattern characters)."""
    return text.contains(F.lit(needle))


def tweet_time(text: Column) -> Column:
    """Parse ``EEE MMM dd HH:mm:ss Z yyyy`` (weekday ignored) to a timestamp."""
    return F.try_to_timestamp(F.substring_index(text, " ", -5), F.lit("MMM dd HH:mm:ss Z yyyy"))


def plain_date(ts: Column) -> Column:
    """Date text without zero padding, e.g. ``2014-1-5``."""
    return F.date_format(ts, "y-M-d")
