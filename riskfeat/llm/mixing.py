"""Mixing sources to target weights, by DataFrame functions only.

Every source is to hold its share of all words: the shares follow the weights, no source is repeated
more than ``most`` times, and what a full source cannot take goes to the others by weight.  A source's
rate is its target over its size; each document is taken floor(rate) times, and once more when a
uniform number made from its id and a seed lies below the rate's fraction.

Nulls and special cases: a null text has size 0, a null source is a source of its own and comes last; a
source without words gets target 0 and rate 0; rows with the same id get the same draw, a null id counts
as the text 'null'; an empty table gives an empty result; other columns are kept by ``emit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.operators.ordered import number_rows
from riskfeat.runtime import broadcast_if_small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Targets stop at so many times a source's size.
MOST = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, size), one row per source.

    The weights repeat over the sources in code-point order.  A source's target is the smaller of
    ``most`` times its size and its weight times a common level; each round raises the level by what
    full sources leave over, and fetches one row of sums.  It ends when a round fills no more.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "sources")
    ranked = number_rows(totals, [], [F.asc_nulls_last("source")], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighed = stored(ranked.select("source", "source_size", weight.cast("bigint").alias("_w")), "weights")
    cap = F.col("source_size") * F.lit(most)
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    above, below = everything, weighed.agg(F.sum("_w")).first()[0] or 1
    while True:
        full = cap.cast("double") * F.lit(below) <= F.lit(above).cast("double") * F.col("_w")
        got = weighed.agg(
            F.sum(F.when(full, cap)).alias("filled"), F.sum(F.when(~full, F.col("_w"))).alias("open")
        ).first()
        left = everything - (got["filled"] or 0)
        if not got["open"] or (left, got["open"]) == (above, below):
            break
        above, below = left, got["open"]
    target = F.when(full, cap.cast("double")).otherwise(F.lit(above).cast("double") * F.col("_w") / F.lit(below).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def uniform(doc_id: str = "doc_id", seed: int = 0) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5 digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def with_copies(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Add source_size, target and ``copies``, the number of times each row is taken."""
    t = targets.withColumnRenamed("source", "_source")
    joined = rows.join(broadcast_if_small(t), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (uniform(seed=seed) < rate - whole).cast("bigint")
    return joined.withColumn("copies", whole + extra)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of every document."""
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    chosen = with_copies(sizes, source_targets(sizes, weights, most), seed)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    targets = source_targets(docs.select("source", word_count().alias("size")), weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source")
    chosen = with_copies(rows, targets, seed).where(F.col("copies") > 0)
    return chosen.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_row.*")
