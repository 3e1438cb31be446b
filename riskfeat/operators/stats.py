"""Counts, group statistics, correlation, quantiles, histograms and shares."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.columns import missing_to_null, nan_free
from riskfeat.operators.quantiles import exact_quantiles
from riskfeat.runtime import collect_bounded


def per_column(df: DataFrame, cols: Iterable[str], measures: Mapping[str, "callable"], name: str = "column") -> DataFrame:
    """One row per column from a single aggregate over all columns."""
    cols = list(cols)
    one = df.agg(
        F.array(
            *[F.struct(F.lit(c).alias(name), *[fn(F.col(f"`{c}`")).alias(m) for m, fn in measures.items()]) for c in cols]
        ).alias("_rows")
    )
    return one.select(F.inline("_rows"))


def group_count(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), *keys)


def group_mean(df: DataFrame, key: str, col: str, out: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(col).alias(out)).orderBy(out, key)


def group_by_date(df: DataFrame, ts: str, unit: str, out: str = "n") -> DataFrame:
    from riskfeat.functions.columns import date_part_text

    return df.groupBy(date_part_text(F.col(ts), unit).alias(unit)).agg(F.count(F.lit(1)).alias(out)).orderBy(unit)


def type_summary(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount")).orderBy(F.desc("n"), *keys)


def share_of_total(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Sum per group and its percent of the whole; the total is taken over the grouped rows."""
    grouped = df.groupBy(*keys).agg(F.sum(measure).alias("total"))
    whole = grouped.agg(F.sum("total").alias("t")).scalar()
    return grouped.withColumn("pct", F.try_divide(F.col("total") * 100, whole))


def pivot_sums(
    df: DataFrame, keys: list[str], pivot: str, values: Sequence, aggs: Mapping[str, Column]
) -> DataFrame:
    """Conditional sums per pivot value; the values are given, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(pivot, list(values)).agg(*[c.alias(n) for n, c in aggs.items()])


def spread_list(df: DataFrame, key: list[str], arr: str, n: int, prefix: str = "item") -> DataFrame:
    """First ``n`` list elements as columns, null beyond the end."""
    return df.select(*key, *[F.get(F.col(arr), F.lit(i)).alias(f"{prefix}{i}") for i in range(n)])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.stat.crosstab(a, b)


def frequent_items(df: DataFrame, col: str, share: float) -> DataFrame:
    """Items making up more than ``share`` of the rows, with exact counts.

    The sketch gives at most 1/share candidates and never misses one; only those are counted.
    """
    candidates = df.stat.freqItems([col], share).select(F.explode(f"{col}_freqItems").alias(col))
    counted = df.select(col).join(F.broadcast(candidates.distinct()), col).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.where(F.col("n") > rows * share)


def covar(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias("covar"))


def corr_expr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null when either does not vary."""
    a, b = missing_to_null(a.cast("double")), missing_to_null(b.cast("double"))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(corr_expr(F.col(a), F.col(b)).alias("corr"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) for every unordered pair, missing values left out pairwise.

    Each task sums the cross moments of its rows as matrices, and only those small matrices are
    shuffled.  NaN is missing.
    """
    cols = list(cols)
    data = df.select(*[missing_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    centre = np.array([m if m is not None else 0.0 for m in data.agg(*[F.avg(c) for c in cols]).first()])
    d = len(cols)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            acc += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(d, 1)
        yield pd.DataFrame(
            {"i": i, "j": j, **{k: acc[p, i, j] for p, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}}
        )

    parts = data.mapInPandas(moments, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    # What is left after cancellation of equal sums counts as no variation.
    flat = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    r = F.when(~flat, F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"), r.alias("correlation"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Square form: one row per feature, one column per feature."""
    half = correlations(df, cols)
    other = half.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation")
    return (
        half.unionByName(other)
        .groupBy(F.col("feature_1").alias("feature"))
        .agg(*[F.max(F.when(F.col("feature_2") == c, F.col("correlation")).when(F.col("feature_1") == c, F.lit(1.0))).alias(c) for c in cols])
    )


def top_abs_correlations(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    pairs = correlations(df, cols).withColumn("correlation", F.abs("correlation"))
    return pairs.where(F.col("correlation") > limit).orderBy(F.desc("correlation"), "feature_1", "feature_2")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(
        df,
        cols,
        {
            "count": F.count,
            "mean": F.avg,
            "stddev": F.stddev_samp,
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
        },
    )


def quantiles(df: DataFrame, col: str, qs: Sequence[float], approximate: bool = False) -> DataFrame:
    """(q, value): exact with linear interpolation, or approximate on request."""
    spark = df.sparkSession
    if approximate:
        one = df.agg(F.percentile_approx(col, F.array(*[F.lit(q) for q in qs])).alias("_v"))
        return one.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("_v").alias("value"))).alias("z")).select("z.q", F.col("z.value").cast("double").alias("value"))
    found = exact_quantiles(df, [], col, qs).get((), {})
    return spark.createDataFrame([(float(q), found.get(q)) for q in qs], "q double, value double")


def _bounds(df: DataFrame, col: str) -> tuple[float, float] | None:
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    return None if lo is None else (lo, hi)


def bucket_number(value: Column, lo: float, hi: float, n: int) -> Column:
    """1 … n over [lo, hi] in equal widths, the last bucket closed."""
    if lo == hi:
        return F.when(value.isNotNull(), F.lit(1))
    return F.least(F.width_bucket(value.cast("double"), F.lit(lo), F.lit(hi), F.lit(n)), F.lit(n)).cast("int")


def histogram(df: DataFrame, col: str, n: int) -> DataFrame:
    """(bucket, lo, hi, n) in equal widths between the smallest and the largest value, NaN left out."""
    spark, df = df.sparkSession, nan_free(df, [col])
    bounds = _bounds(df, col)
    if bounds is None:
        return spark.createDataFrame([], "bucket int, lo double, hi double, n bigint")
    lo, hi = bounds
    buckets = 1 if lo == hi else n
    width = (hi - lo) / buckets
    frame = spark.range(1, buckets + 1).select(
        F.col("id").cast("int").alias("bucket"),
        (F.lit(lo) + (F.col("id") - 1) * width).alias("lo"),
        F.when(F.col("id") == buckets, F.lit(hi)).otherwise(F.lit(lo) + F.col("id") * width).alias("hi"),
    )
    counted = df.where(F.col(col).isNotNull()).groupBy(bucket_number(F.col(col), lo, hi, n).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket")


def band_of(value: Column, limits: Sequence[float]) -> Column:
    """How many limits lie below the value: 0 up to the first limit, 1 up to the second …"""
    band = F.when(value.isNull(), F.lit(None))
    for i, limit in enumerate(sorted(limits)):
        band = band.when(value <= limit, F.lit(i))
    return band.otherwise(len(limits)).cast("int")


def band_counts(df: DataFrame, col: str, limits: Sequence[float]) -> DataFrame:
    return df.groupBy(band_of(F.col(col), limits).alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy("band")


def banded_histogram(
    df: DataFrame, col: str, limits: Sequence[float], n: int, above: float | None = None, below: float | None = None
) -> DataFrame:
    """Equal-width histogram inside each value band, over values in (above, below) where given."""
    kept = nan_free(df, [col]).where(F.col(col).isNotNull())
    if above is not None:
        kept = kept.where(F.col(col) > above)
    if below is not None:
        kept = kept.where(F.col(col) < below)
    banded = kept.select(band_of(F.col(col), limits).alias("band"), F.col(col).cast("double").alias("_v"))
    bounds = collect_bounded(banded.groupBy("band").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    bucket = F.lit(None).cast("int")
    for r in bounds:
        bucket = F.when(F.col("band") == r["band"], bucket_number(F.col("_v"), r["lo"], r["hi"], n)).otherwise(bucket)
    return banded.groupBy("band", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("band", "bucket")


def numeric_features(df: DataFrame, cols: Sequence[str], k: int = 10, approximate: bool = False) -> list[str]:
    """Columns with more than ``k`` distinct values, from one aggregate over all columns."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    found = df.agg(*[count(F.col(c)).alias(c) for c in cols]).first()
    return [c for c in cols if found[c] > k]


def binary_features(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns whose values are all 0 or 1."""
    found = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in cols]).first()
    return [c for c in cols if found[c]]


def long_features(df: DataFrame, keep: Sequence[Column | str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per feature and row of ``df``, as doubles; no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in cols])
    return df.select(*keep, F.inline(pairs))


def feature_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, missing, zero, n_unique): shares of all rows and the number of distinct values."""
    missing = lambda c: F.count_if(c.isNull()) / F.count(F.lit(1))
    zero = lambda c: F.count_if(c == 0) / F.count(F.lit(1))
    return per_column(nan_free(df, cols), cols, {"missing": missing, "zero": zero, "n_unique": F.count_distinct}, "feature")


