"""Operators over token arrays and phrase lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.fixed_values import KEPT_SHORT_TOKENS
from riskfeat.functions.text import (
    clean, computed_once, ngram_array, phrase_pattern, remove_stopwords, rules_category, sorted_text, tokens, usable_phrases,
)
from riskfeat.operators.joins import fuzzy_token_pairs
from riskfeat.operators.rows import first_per_key, top_k_dense
from riskfeat.runtime import stored



def word_frequency(df: DataFrame, words: str, without: Sequence[str] = ()) -> DataFrame:
    """(word, n), most frequent first, without the listed words."""
    exploded = df.select(F.explode(words).alias("word"))
    if without:
        exploded = exploded.where(~F.col("word").isin(sorted(without)))
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")


def token_report(df: DataFrame, words: str, n: str, amount: str) -> DataFrame:
    """(token, occurrences, n, amount, token_freq, freq_n, freq_amount), all three in percent.

    ``token_freq`` is per distinct token; the other two are per total over the texts before they are
    split, so a text with three tokens counts three times and they add up to more than 100.
    """
    # The texts are read once: a text's first row, which one without tokens has too, also brings its part of the totals.
    rows = df.select(F.posexplode_outer(words).alias("_at", "token"), n, amount)
    first, found = F.coalesce("_at", F.lit(0)) == 0, F.col("_at").isNotNull()
    counts = stored(rows.groupBy("token").agg(
        F.count("_at").alias("occurrences"), F.sum(F.when(found, F.col(n))).alias("n"), F.sum(F.when(found, F.col(amount))).alias("amount"),
        F.sum(F.when(first, F.col(n))).alias("_n"), F.sum(F.when(first, F.col(amount))).alias("_amount"),
    ), "token-counts")
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.sum("_amount").alias("amount"))).scalar()
    grouped = counts.where("occurrences > 0").drop("_n", "_amount")
    distinct_tokens = grouped.agg(F.count(F.lit(1))).scalar()

    def pct(part: Column, whole: Column) -> Column:
        return F.try_divide(part * 100, whole)

    return grouped.select(
        "*",
        pct(F.col("occurrences"), distinct_tokens).alias("token_freq"),
        pct(F.col("n"), totals.getField("n")).alias("freq_n"),
        pct(F.col("amount"), totals.getField("amount")).alias("freq_amount"),
    )


def token_candidates(
    report: DataFrame,
    below: float | None = None,
    min_len: int = 0,
    max_len: int | None = None,
    keep: Sequence[str] = KEPT_SHORT_TOKENS,
    by: str = "token_freq",
) -> DataFrame:
    """Rare or short tokens for review, highest share first, without the listed ones."""
    found = report.where(~F.col("token").isin(list(keep))) if keep else report
    if below is not None:
        found = found.where(F.col(by) < below)
    found = found.where(F.length("token") >= min_len)
    if max_len is not None:
        found = found.where(F.length("token") <= max_len)
    return found.orderBy(F.desc(by), "token")


def contains_any(df: DataFrame, col: str, phrases: Sequence[str] | DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose text holds a phrase as a run of whole words, whatever white space lies between them.

    A table with a column ``phrase`` is matched by an equi-join of the text's word runs with the
    phrases, and ``key`` names the text's id for that.  A list is one pattern on the text with its white
    space squeezed, which comes to the same.
    """
    if not isinstance(phrases, DataFrame):
        listed = usable_phrases(" ".join(p.split()) for p in phrases if p)
        if not listed:
            return df.limit(0)
        squeezed = F.trim(F.regexp_replace(F.col(col), r"\s+", " "))
        return df.where(squeezed.rlike(phrase_pattern(listed)))
    if key is None:
        raise ValueError("a table of phrases needs the key of the texts")
    hits = phrase_hits(df, col, phrases, key).select(*key).distinct()
    return df.join(hits, key, "left_semi")


def phrase_hits(df: DataFrame, col: str, phrases: DataFrame, key: list[str]) -> DataFrame:
    """Distinct (key, phrase) for phrases found as runs of whole words."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    clean_phrases = phrases.select(F.array_join(words(F.col("phrase")), " ").alias("phrase")).where(F.col("phrase") != "").distinct()
    lengths = clean_phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect())
    if not sizes:
        return df.select(*key, F.lit("").alias("phrase")).limit(0)
    runs = F.array_distinct(F.concat(*[ngram_array(F.col("_w"), n) for n in sizes]))
    texts = computed_once(df, key, _w=words(F.col(col)))
    return texts.select(*key, F.explode(runs).alias("phrase")).join(clean_phrases, "phrase").select(*key, "phrase").distinct()


def matched_phrase(df: DataFrame, col: str, phrases: Sequence[str]) -> DataFrame:
    """Adds ``match``, the phrase found first (the longer one when two start together), and its length."""
    return df.withColumn("match", F.regexp_extract(col, phrase_pattern(phrases), 2)).withColumn(
        "match_len", F.length("match")
    )


def categorize(df: DataFrame, col: str, rules: list[tuple[str, list[str]]], out: str = "category") -> DataFrame:
    return df.withColumn(out, rules_category(F.col(col), rules))


def identify_accounts(
    payments: DataFrame, account: str, text: str, n: str, amount: str, phrases: Sequence[str], more_than: int = 10
) -> DataFrame:
    """(account, text, n, amount) of accounts whose two most frequent texts name a listed payee.

    ``payments`` has one row per account and cleaned text.  Accounts with any hit are kept, of their
    texts used more than ``more_than`` times those with the two highest counts, of these the hits; the
    most frequent one names the account.
    """
    known = contains_any(payments, text, phrases).select(account).where(F.col(account).isNotNull()).distinct()
    theirs = payments.join(known, account, "left_semi").where(F.col(n) > more_than)
    top = contains_any(top_k_dense(theirs, [account], n, 2), text, phrases)
    names = first_per_key(top, [account], [F.desc(n), F.desc(amount), F.col(text)]).select(account, text)
    totals = top.groupBy(account).agg(F.sum(n).alias(n), F.sum(amount).alias(amount))
    return names.join(totals, account)


def fuzzy_match(
    texts: DataFrame, names: DataFrame, key: str, text: str, name: str, stop_words: Sequence[str]
) -> DataFrame:
    """(name, key, text, distance): texts and payee names that share a nearly equal word.

    Clean, split into words, drop stop words, sort, split again, match distinct words, and attach the
    texts and names only then.
    """
    t = texts.select(key, F.col(text)).withColumn("_w", tokens(clean(F.col(text)), 2))
    t = remove_stopwords(t, "_w", "_w", stop_words).where(F.size("_w") > 0)
    t = t.select(key, text, F.explode(F.array_distinct(tokens(sorted_text(F.col("_w")), 1))).alias("l"))
    p = names.select(F.col(name)).distinct().withColumn("_w", tokens(clean(F.col(name)), 2))
    p = p.select(name, F.explode(F.array_distinct(tokens(sorted_text(F.col("_w")), 1))).alias("r"))
    pairs = fuzzy_token_pairs(t, p, "l", "r")
    named = pairs.join(p, "r").select("l", name, "distance").distinct()
    return t.join(named, "l").select(name, key, text, "distance").distinct()
