"""Column and table profiles, each from one pass over the table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.columns import nan_free
from riskfeat.operators.stats import per_column
from riskfeat.runtime import collect_bounded


def _n_null(c):
    return F.count_if(c.isNull())


def _rows(_c):
    return F.count(F.lit(1))


def overview(df: DataFrame) -> DataFrame:
    """(column, dtype, pct_missing)."""
    types = dict(df.dtypes)
    found = per_column(nan_free(df), df.columns, {"pct_missing": lambda c: F.try_divide(_n_null(c) * F.lit(100.0), _rows(c))})
    dtype = F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.col("column"))
    return found.select("column", dtype.alias("dtype"), "pct_missing")


def drop_sparse(df: DataFrame, pct: float) -> DataFrame:
    """Without the columns that miss more than ``pct`` percent of their values."""
    sparse = collect_bounded(overview(df).where(F.col("pct_missing") > pct))
    return df.drop(*[r["column"] for r in sparse])


def split_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, is_empty); reads one row per table."""
    parts = [
        df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty")).select(F.lit(name).alias("table_name"), "is_empty")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def population_status(df: DataFrame) -> DataFrame:
    """(column, status): fully populated, partly populated or empty."""
    counts = per_column(df, df.columns, {"n_null": _n_null, "n": _rows})
    status = (
        F.when(F.col("n_null") == 0, "fully populated").when(F.col("n_null") < F.col("n"), "partly populated").otherwise("empty")
    )
    return counts.select("column", status.alias("status"))


def population_report(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """(column, status) as text with the shares of missing values and, for non-text columns, zeros."""
    skip = set(skip)
    cols = [c for c in df.columns if c not in skip]
    types = dict(df.dtypes)
    numeric = {c for c in cols if types[c].split("(")[0] in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}}
    one = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    _n_null(F.col(c)).alias("n_null"),
                    (F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("bigint")).alias("n_zero"),
                    _rows(c).alias("n"),
                )
                for c in cols
            ]
        ).alias("_r")
    ).select(F.inline("_r"))
    checks_zero = F.col("column").isin(sorted(numeric)) if numeric else F.lit(False)
    null_share = F.format_string("%.4f", F.try_divide(F.col("n_null"), F.col("n")))
    zero_share = F.format_string("%.4f", F.try_divide(F.col("n_zero"), F.col("n")))
    partly = F.col("n_null") < F.col("n")
    status = (
        F.when((F.col("n_null") == 0) & (F.col("n_zero") == 0), "100% populated")
        .when(F.col("n_null") == 0, F.concat(zero_share, F.lit(" values are 0")))
        .when(partly & ~checks_zero, F.concat(null_share, F.lit(" missing")))
        .when(partly & (F.col("n_zero") == 0), F.concat(null_share, F.lit(" missing and no zero")))
        .when(partly, F.concat(null_share, F.lit(" missing and "), zero_share, F.lit(" zero")))
        .otherwise("0% populated")
    )
    return one.select("column", status.alias("status"))


def null_count_distribution(df: DataFrame) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns])
    return df.groupBy(nulls.alias("n_nulls")).agg(F.count(F.lit(1)).alias("n")).orderBy("n_nulls")


def basic_stats(df: DataFrame, label: str) -> DataFrame:
    """(label, n, n_rows, n_columns) per label value."""
    per_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = per_label.agg(F.sum("n").alias("n")).scalar()
    return per_label.select(F.col(label).alias("label"), "n", whole.alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def partition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n")).orderBy("partition")


def table_columns(dfs: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column, n_present): every column of every table with its number of values."""
    parts = [
        per_column(df, df.columns, {"n_present": F.count}).select(F.lit(t).alias("table_name"), "column", "n_present")
        for t, df in dfs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def duplicate_columns(dfs: Mapping[str, DataFrame]) -> DataFrame:
    """Column names found with values in more than one table."""
    found = table_columns(dfs).where(F.col("n_present") > 0)
    return (
        found.groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_present").alias("n_present"))
        .where(F.col("n_tables") > 1)
    )


def merge_key_candidates(dfs: Mapping[str, DataFrame], at_least: int, at_most: int) -> DataFrame:
    """Columns shared by between ``at_least`` and ``at_most`` tables, with the table names."""
    found = table_columns(dfs).where(F.col("n_present") > 0)
    # One element per table of the caller's list, so the collected array is as short as that list.
    return (
        found.groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_tables"), F.concat_ws(",", F.array_sort(F.collect_set("table_name"))).alias("tables"))
        .where(F.col("n_tables").between(at_least, at_most))
    )
