"""Catalog tables, SQL text and named views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def with_views(frames: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Run SQL text over DataFrames under the given view names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return next(iter(frames.values())).sparkSession.sql(text)


def list_tables(spark: SparkSession, db: str | None = None, contains: str = "") -> DataFrame:
    """Names of the catalog's tables and views that contain ``contains``."""
    names = spark.sql("show tables" + (f" in `{db}`" if db else ""))
    return names.where(F.col("tableName").contains(contains)).select(F.col("tableName").alias("table_name"))


def rows(spark: SparkSession, values: list[tuple], cols: list[str] | str) -> DataFrame:
    return spark.createDataFrame(values, cols)


def id_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end)
