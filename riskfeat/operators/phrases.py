"""Long lists of phrases, held as a table, found in texts as runs of whole words.

Phrases are keyed by their head: the first two words, or the only one.  A text brings two heads per word, and only
places whose head begins some phrase go on; there a run is made for each length that phrases of this head have, and
runs meet phrases by equality.  So the rows made do not grow with the longest phrase or with the number of phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.text import computed_once
from riskfeat.runtime import broadcast_if_small, same, stored


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _run(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def phrase_heads(words: DataFrame, key: list[str]) -> DataFrame:
    """(key…, _text, position, head): at each word of ``_w`` the word alone, and with the word after it."""
    place = F.transform("_w", lambda w, i: F.struct(i.alias("position"), w.alias("_one"), F.get(F.col("_w"), i + 1).alias("_next")))
    places = words.select(*key, "_text", F.inline(place))
    pair = F.when(F.col("_next").isNotNull(), F.concat_ws(" ", "_one", "_next"))
    return places.select(*key, "_text", "position", F.explode(F.array("_one", pair)).alias("head")).where(F.col("head").isNotNull())


def phrase_places(df: DataFrame, col: str, phrases: DataFrame, key: list[str]) -> DataFrame:
    """Distinct (key…, position, phrase, n_words): where a phrase of the table stands in the text, words counted from 0.

    ``phrases`` has a column ``phrase``; any white space parts words, in phrases and texts.  Null and blank phrases
    and null texts match nothing; rows with the same key are read as texts of their own and their places united; a null in
    the key is a key.
    """
    listed = phrases.select(_words(F.col("phrase")).alias("_p")).where(F.size("_p") > 0).distinct()
    listed = listed.select(F.array_join("_p", " ").alias("phrase"), F.size("_p").alias("n_words"), F.array_join(F.slice("_p", 1, 2), " ").alias("head"))
    listed = stored(listed, "phrases")
    heads = listed.groupBy("head").agg(F.collect_set("n_words").alias("_lengths"))

    words = stored(computed_once(df, key, _w=_words(F.col(col))).where(F.size("_w") > 0).withColumn("_text", F.xxhash64("_w")), "words")
    begun = phrase_heads(words, key).join(broadcast_if_small(heads), "head")
    # The places of one text, no more than two per word of it, go back to its words.
    begun = begun.groupBy(*key, "_text").agg(F.collect_set(F.struct("position", "_lengths")).alias("_places"))
    # A run that would pass the end of the text is none.
    fits = lambda p: F.filter(p["_lengths"], lambda n: p["position"] + n <= F.size("_w"))
    runs = F.flatten(F.transform("_places", lambda p: F.transform(
        fits(p), lambda n: F.struct(p["position"].alias("position"), n.alias("n_words"), _run(F.col("_w"), p["position"], n).alias("phrase"))
    )))
    joined = words.alias("a").join(begun.alias("b"), same([*key, "_text"])).select(*[F.col(f"a.`{k}`").alias(k) for k in key], "_w", "_places")
    made = joined.select(*key, F.inline(runs))
    return made.join(broadcast_if_small(listed.select("phrase")), "phrase").select(*key, "position", "phrase", "n_words").distinct()


def first_phrase(df: DataFrame, col: str, phrases: DataFrame, key: list[str]) -> DataFrame:
    """(key…, position, match, n_words): the phrase found first in each text, the longer one when two start together."""
    at = phrase_places(df, col, phrases, key)
    best = at.groupBy(*key).agg(F.min(F.struct("position", (-F.col("n_words")).alias("_less"), "phrase")).alias("_b"))
    return best.select(*key, "_b.position", F.col("_b.phrase").alias("match"), (-F.col("_b._less")).alias("n_words"))
