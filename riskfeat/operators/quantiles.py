"""Exact quantiles per key (feature, segment) without holding a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.operators.ordered import running_totals
from riskfeat.runtime import same

Key = tuple


def quantile_rows(df: DataFrame, keys: list[str], value: str, fractions: Sequence[float], out: str = "quantiles", weight: str | None = None) -> DataFrame:
    """(keys…, out): the linearly interpolated quantiles of ``value`` per key, nulls and NaN left out.

    With ``weight`` a row stands for as many equal rows as that column says.

    Rows are first summed to distinct values.  Running counts over these, which may span many tasks,
    tell which values hold the wanted ranks, and one aggregate picks them.
    """
    v = F.col(value).cast("double")
    n = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*keys, v.alias("_v"), n.cast("bigint").alias("_w")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    histogram = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    counted = running_totals(histogram, keys, ["_v"], {"_to": "_n"})
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_rows")) if keys else counted.agg(F.sum("_n").alias("_rows"))
    ranked = counted.alias("a").join(sizes.alias("b"), same(keys)).select("a.*", "_rows")

    def at(rank: Column) -> Column:
        """The value at a rank: no other row of the key covers it."""
        return F.max(F.when((rank >= F.col("_to") - F.col("_n")) & (rank < F.col("_to")), F.col("_v")))

    spots = [F.lit(float(f)) * (F.col("_rows") - 1) for f in fractions]
    names = [(f"_l{i}", f"_h{i}") for i in range(len(fractions))]
    picks = [at(r).alias(n) for h, (lo, hi) in zip(spots, names, strict=True) for r, n in ((F.floor(h), lo), (F.ceil(h), hi))]
    found = ranked.groupBy(*keys, "_rows").agg(*picks)
    between = [F.col(lo) + (F.col(hi) - F.col(lo)) * (h - F.floor(h)) for h, (lo, hi) in zip(spots, names, strict=True)]
    return found.select(*keys, F.array(*between).alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: Sequence[float], weight: str | None = None) -> dict[Key, dict[float, float]]:
    """The quantiles on the driver, for keys that the caller lists (columns of a table)."""
    fractions = sorted(set(fractions))
    rows = quantile_rows(df, keys, value, fractions, weight=weight).collect()
    return {tuple(r[k] for k in keys): dict(zip(fractions, r["quantiles"], strict=True)) for r in rows}
