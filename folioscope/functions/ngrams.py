"""Tokens, n-grams and copied runs as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Words that carry no content in either language.
STOPWORDS = ["a", "an", "and", "as", "at", "con", "de", "del", "el", "en", "for", "in", "la", "los", "of", "para", "por", "the", "to", "un", "una", "with", "y"]


def _none() -> Column:
    return F.array().cast("array<string>")


def content_tokens(text: Column) -> Column:
    """Lower-case words of more than two letters that are no stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Záéíóúñü']+)"), F.lit(1))
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def windows(tokens: Column, n: int | Column) -> Column:
    """All n-grams in order, tokens joined by spaces; empty where too short."""
    n = F.lit(n) if isinstance(n, int) else n

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - n + 1)
        return F.when((n > 0) & (F.size(t) >= n), F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(_none())

    return bind(tokens, cut)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams."""
    return F.array_distinct(windows(tokens, n))


def copied_positions(tokens: Column, other: Column, n: Column) -> Column:
    """Places (from 0) of ``tokens`` that lie in a run of ``n`` tokens which
    also stands in ``other``; none if ``n`` is below 2."""

    def places(theirs: Column) -> Column:
        starts = F.filter(F.transform(windows(tokens, n), lambda w, i: F.when(F.array_contains(theirs, w), i)), lambda i: i.isNotNull())
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + n - 1))))

    return F.when((n >= 2) & (F.size(other) >= n), bind(windows(other, n), places)).otherwise(F.array().cast("array<int>"))


def run_length(seed: Column, run: int) -> Column:
    return F.least(F.lit(run), F.size(seed))
