"""Text-based files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = False) -> DataFrame:
    """CSV with a header; all columns text, or with inferred types (one more pass over the file)."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=infer)


def read_lookup(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def line_words(lines: DataFrame, col: str = "line", pattern: str = " ") -> DataFrame:
    return lines.select(F.explode(F.split(F.col(col), pattern)).alias("word")).where(F.col("word") != "")
