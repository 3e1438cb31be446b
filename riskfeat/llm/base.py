"""Registry of the queries of this subpackage and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfeat.plans.base import Query
from riskfeat.runtime import ship
from riskfeat.sources.tables import parquet_table

BOOK: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in plain SQL, left out where SQL cannot say it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in BOOK:
            raise ValueError(f"{name} is registered twice")
        BOOK[name] = Query(fn, sql)
        return fn

    return register


#: Rows of one Arrow batch: texts are long, and two tasks share an executor's memory outside the heap.
BATCH_ROWS = 2_000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return parquet_table(spark, folder, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
