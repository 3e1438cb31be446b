"""Ranks, best rows, neighbours, running lists, sorts and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.operators.ordered import Order, _cols, number_rows, with_neighbours
from riskfeat.runtime import same

__all__ = [
    "add_id", "first_per_key", "number_rows", "offset_pairs", "running_list", "sort_rows", "top_k_dense",
    "top_n", "union_all", "union_tagged", "with_neighbours",
]


def top_k_dense(df: DataFrame, part: list[str], value: str, k: int, out: str = "rank") -> DataFrame:
    """Rows whose value is among the ``k`` highest distinct values of the group, with that rank.

    Ranks are taken over distinct values: at most ``k`` rows per group and map task are shuffled for
    the ranking, however many rows share a value.
    """
    w = Window.partitionBy(*part).orderBy(F.desc(value))
    ranks = df.select(*part, value).distinct().withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
    joined = df.alias("a").join(ranks.alias("b"), same([*part, value]))
    return joined.select("a.*", F.col(f"b.`{out}`"))


def first_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """Best row per key under the order; Spark keeps one row per key and map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def add_id(df: DataFrame, order: Order | None = None, out: str = "id") -> DataFrame:
    """Row id: 1, 2, 3 … in the stated order, or any unique number when no order is given."""
    if order is None:
        return df.withColumn(out, F.monotonically_increasing_id())
    return number_rows(df, [], order, out)


def offset_pairs(
    df: DataFrame,
    party: str,
    date: str,
    amount: str,
    type_col: str | None,
    row_id: str,
    out: str = "sum_check",
    largest_first: bool = False,
) -> DataFrame:
    """0, 1 or 2: how many of the party's neighbouring rows carry the opposite amount on the same date.

    With ``type_col`` the neighbour also has to be of the same type.  Neighbours are taken within
    (party, date, type) in the order absolute amount, amount, id: a neighbour from another date or
    type can never match, so this grouping gives the same result with smaller groups.
    """
    keys = [party, date] + ([type_col] if type_col else [])
    by_amount = F.desc(amount) if largest_first else F.asc(amount)
    near = with_neighbours(df, keys, [F.abs(F.col(amount)), by_amount, F.col(row_id)], [amount], "_prev", "_next")

    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])

    def opposite(side: str) -> Column:
        return F.when(known & (F.col(amount) + F.col(f"{side}.{amount}") == 0), 1).otherwise(0)

    return near.withColumn(out, opposite("_prev") + opposite("_next")).drop("_prev", "_next")


def running_list(df: DataFrame, words: str, key: list[str], out: str = "so_far") -> DataFrame:
    """One row per word of a text, in sorted order, with the words up to and including it."""
    ordered = F.array_sort(F.col(words))
    return df.select(*key, ordered.alias("_all"), F.posexplode(ordered).alias("pos", "word")).select(
        *key, "pos", "word", F.slice("_all", F.lit(1), F.col("pos") + 1).alias(out)
    )


def sort_rows(df: DataFrame, order: Order, within_partitions: bool = False) -> DataFrame:
    cols = _cols(order)
    return df.sortWithinPartitions(*cols) if within_partitions else df.orderBy(*cols)


def top_n(df: DataFrame, score: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    return union_all(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])
