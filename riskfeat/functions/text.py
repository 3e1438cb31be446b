"""Text columns: cleaning, tokens, stop words, n-grams, phrase patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.fixed_values import NOT_LETTER_OR_DIGIT, SPELLED_OUT, WHOLE_NUMBER


def clean(text: Column) -> Column:
    """Lower case, letters and digits only, å ä ö spelled out, whole numbers dropped, single blanks."""
    text = F.regexp_replace(F.lower(text), NOT_LETTER_OR_DIGIT, " ")
    for letter, spelled in SPELLED_OUT:
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    text = F.regexp_replace(text, WHOLE_NUMBER, "")
    return F.trim(F.regexp_replace(text, "  +", " "))


def clean_text(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, clean(F.col(src)))


def tokens(text: Column, min_len: int = 2) -> Column:
    """Lower-cased pieces between non-word characters, at least ``min_len`` long."""
    return F.filter(F.split(F.lower(text), r"\W"), lambda t: F.length(t) >= max(min_len, 1))


def tokenize(df: DataFrame, src: str, dst: str, min_len: int = 2) -> DataFrame:
    return df.withColumn(dst, tokens(F.col(src), min_len))


def without_words(arr: Column, words: Iterable[str]) -> Column:
    """Tokens not in the list, compared without regard to case; order and repeats stay."""
    listed = sorted({w.lower() for w in words})
    return F.filter(arr, lambda t: ~F.lower(t).isin(listed)) if listed else arr


def remove_stopwords(df: DataFrame, src: str, dst: str, words: Iterable[str]) -> DataFrame:
    return df.withColumn(dst, without_words(F.col(src), words))


def sorted_text(arr: Column) -> Column:
    return F.concat_ws(" ", F.array_sort(arr))


def sorted_words(df: DataFrame, words: str, dst: str) -> DataFrame:
    """The words of each row, repeats kept, sorted and joined by blanks."""
    return df.withColumn(dst, sorted_text(F.col(words)))


def computed_once(df: DataFrame, keep: Iterable[str], **cols: Column) -> DataFrame:
    """Columns evaluated before anything built on them.

    Spark merges neighbouring projections, which would put a costly expression inside a lambda and run
    it again for every array element.  A one-element generator keeps the two steps apart.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.inline(F.array(row)))


def ngram_array(arr: Column, n: int) -> Column:
    """Runs of ``n`` words; ``arr`` should be a stored column, not an expression."""
    last = F.size(arr) - n + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    # Single elements are read in place; a slice would copy the array for every start.
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(arr, i - 1 + j) for j in range(n)]))


def ngrams(df: DataFrame, words: str, n: int, dst: str = "ngrams") -> DataFrame:
    kept = [c for c in df.columns if c != words]
    return computed_once(df, kept, **{words: F.col(words)}).withColumn(dst, ngram_array(F.col(words), n))


def usable_phrases(phrases: Iterable[str]) -> list[str]:
    """Longest first, since alternation takes the first that fits; empty ones would match everything."""
    return sorted({p.strip() for p in phrases if p and p.strip()}, key=lambda p: (-len(p), p))


def phrase_pattern(phrases: Iterable[str]) -> str:
    return r"(^|\s)(" + "|".join(re.escape(p).replace(r"\ ", " ") for p in usable_phrases(phrases)) + r")(\s|$)"


def rules_category(text: Column, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """First rule whose keyword pattern occurs in the upper-cased text."""
    upper = F.upper(text)
    branches = [(upper.rlike("|".join(words)), name) for name, words in rules]
    head, *rest = branches
    return reduce(lambda w, b: w.when(*b), rest, F.when(*head)).otherwise(other)


def html_text(html: Column, tag: str, cls: str | None = None) -> Column:
    """Text of the first element with this tag (and class); inner tags removed, blanks squeezed."""
    attr = r"(?:\s[^>]*)?" if cls is None else rf"\s[^>]*class=[\"']?(?:[^\"'>]*\s)?{re.escape(cls)}(?:[\s\"'][^>]*)?"
    inner = F.regexp_extract(html, rf"(?is)<{tag}{attr}>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))
