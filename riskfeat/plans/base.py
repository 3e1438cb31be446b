"""Registry of the composed queries and what they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.runtime import spread
from riskfeat.sources.tables import parquet_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


BOOK: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in plain SQL, left out where SQL cannot say it."""

    def register(fn):
        if name in BOOK:
            raise ValueError(f"{name} is registered twice")
        BOOK[name] = Query(fn, sql)
        return fn

    return register


load = parquet_table


def money(col: str | Column) -> Column:
    """Sum in decimals, so that the result does not depend on the order of addition."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def money_sql(text: str) -> str:
    return f"CAST(sum(CAST({text} AS DECIMAL(18,2))) AS DOUBLE)"


def r6(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# Missing values are made the same way in Spark and in SQL, since the tables hold none.
HOLE = "(l_orderkey + l_linenumber) % 7 = 0"


def with_holes(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a feature table: four features, three of them with missing values, label and segment."""
    return spread(load(spark, folder, "lineitem")).selectExpr(
        "l_orderkey",
        f"CASE WHEN {HOLE} THEN NULL ELSE l_quantity END AS quantity",
        "l_extendedprice AS price",
        "CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_discount END AS discount",
        "CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_tax END AS tax",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
        "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS segment",
    )


FEATURES = ["quantity", "price", "discount", "tax"]
HOLES_SQL = f"""feats AS (
  SELECT l_orderkey,
    CASE WHEN {HOLE} THEN NULL ELSE l_quantity END AS quantity,
    l_extendedprice AS price,
    CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_discount END AS discount,
    CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS segment
  FROM lineitem)"""
