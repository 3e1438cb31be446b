"""Cutting a table into ranges of a key, the same way in every run."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.operators.ordered import number_rows

#: So many ranges at most, since their bounds pass through the driver.
MOST_RANGES = 20_000


def bounds(keys: DataFrame, key: str, n_rows: int, n_ranges: int) -> list[int]:
    """Every (n_rows / n_ranges)-th key in exact order, so that the ranges hold as many rows each."""
    n_ranges = min(n_ranges, MOST_RANGES)
    if n_ranges < 2:
        return []
    step = -(-n_rows // n_ranges)
    ranked = number_rows(keys.select(key), [], [F.asc_nulls_first(key)], "_rank")
    cuts = ranked.where((F.col("_rank") > 1) & (F.col("_rank") % step == 1 % step) & F.col(key).isNotNull())
    return sorted({r[0] for r in cuts.select(key).collect()})


def with_range(df: DataFrame, key: str, cuts: list[int], out: str) -> DataFrame:
    """Add the number of the range that ``key`` falls in; null keys are in range 0.

    Keys are compared as doubles.  Beyond 2^53 neighbouring keys may then share a range they would not
    share by exact comparison, but order is kept and equal keys stay together.
    """
    splits = sorted({float(c) for c in cuts})
    if not splits:
        return df.withColumn(out, F.lit(0))
    at = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    cutter = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_key", outputCol="_range", handleInvalid="keep")
    return cutter.transform(at).withColumn(out, F.col("_range").cast("int")).drop("_key", "_range")
