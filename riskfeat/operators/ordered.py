"""Ordered computations per group that survive one group holding most of the rows.

All rows are range-partitioned on (keys, order) and stored once, so one group may span many chunks.
Windows then run per (keys, chunk).  At most one group enters a chunk from the chunk before it, so what
is carried over the borders is at most one small row per chunk, whatever the number of groups.

Rows that tie in the stated order are taken in the order of a hash of their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.runtime import same, stored

CHUNK = "_chunk"
TIE = "_tie"
Order = Sequence["str | Column"]
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
ALL_BEFORE = (Window.unboundedPreceding, -1)


def _cols(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _chunked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in range order with the number of each row's chunk, stored."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ranged = tied.repartitionByRange(n, *[F.col(f"`{k}`") for k in keys], *order, F.col(TIE))
    return stored(ranged.withColumn(CHUNK, F.spark_partition_id()), "ordered")


def _in_chunk(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order, TIE)


def _over_chunks(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    # Only groups that go on from another chunk are carried: at most one or two rows per chunk.
    return rows.alias("a").join(F.broadcast(carry).alias("b"), same([*keys, CHUNK]), "left")


def running_totals(df: DataFrame, keys: list[str], order: Order, sums: dict[str, str | Column]) -> DataFrame:
    """Running sums per group, the row itself included.  ``sums`` maps new name to what is summed."""
    cols = _cols(order)
    names = df.columns
    rows = _chunked(df, keys, cols)
    totals = rows.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = _over_chunks(keys).rowsBetween(*ALL_BEFORE)
    carry = totals.select(
        *keys, CHUNK, F.row_number().over(_over_chunks(keys)).alias("_nth"), *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in sums]
    ).where(F.col("_nth") > 1)
    w = _in_chunk(keys, cols).rowsBetween(*UP_TO_HERE)
    local = rows.withColumns({f"_l_{o}": F.sum(c).over(w) for o, c in sums.items()})
    total = [F.when(F.col(f"_b_{o}").isNull(), F.col(f"_l_{o}")).otherwise(F.coalesce(F.col(f"_l_{o}") + F.col(f"_b_{o}"), F.col(f"_b_{o}"))).alias(o) for o in sums]
    return _with_carry(local, carry, keys).select(*[F.col(f"a.`{c}`") for c in names], *total)


def number_rows(df: DataFrame, keys: list[str], order: Order, out: str) -> DataFrame:
    """1, 2, 3 … per group in the stated order; with no keys, over the whole table."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("bigint")})


def with_neighbours(
    df: DataFrame, keys: list[str], order: Order, cols: list[str], prev: str | None = "prev", nxt: str | None = "next"
) -> DataFrame:
    """Add the previous and the next row of the group as structs of ``cols`` (null at the ends)."""
    order_cols = _cols(order)
    names = df.columns
    me = F.struct(*[F.col(c) for c in cols])
    rows = _chunked(df, keys, order_cols)
    w = _in_chunk(keys, order_cols)
    local = rows.withColumns({"_p": F.lag(me).over(w), "_n": F.lead(me).over(w)})
    ends = local.where(F.col("_p").isNull() | F.col("_n").isNull()).withColumn("_me", me).groupBy(*keys, CHUNK).agg(
        F.first(F.when(F.col("_p").isNull(), F.col("_me")), ignorenulls=True).alias("_first"),
        F.first(F.when(F.col("_n").isNull(), F.col("_me")), ignorenulls=True).alias("_last"),
    )
    across = _over_chunks(keys)
    carry = ends.select(
        *keys, CHUNK, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")
    ).where(F.col("_before").isNotNull() | F.col("_after").isNotNull())
    out = [F.col(f"a.`{c}`") for c in names]
    if prev:
        out.append(F.coalesce("_p", "_before").alias(prev))
    if nxt:
        out.append(F.coalesce("_n", "_after").alias(nxt))
    return _with_carry(local, carry, keys).select(*out)
