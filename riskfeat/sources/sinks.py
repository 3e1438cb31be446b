"""Writing results.

A table is replaced by staging: the new rows are written whole to a version folder of their own and counted
there; only then does the name point to that folder, and the folder before it goes.  A write that fails leaves the old
table as it was.  A table may be replaced by rows read from itself.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from riskfeat.runtime import drop_folder

VERSION = "__version_"


def save_table(df: DataFrame, name: str, fmt: str = "orc", partition_by: list[str] | None = None) -> None:
    """Write or replace the table ``name``; its files are in a version folder of the warehouse."""
    spark, parts = df.sparkSession, list(partition_by or [])
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = f"{warehouse}/{name.replace('`', '')}{VERSION}{uuid.uuid4().hex}"
    # Not counted by an Observation: it leaves its manager in the session, which cannot be serialised, and every two-class
    # model fitted later takes the session into its tasks with its training summary.
    kept = df.storageLevel == StorageLevel.NONE
    if kept:
        df.persist(StorageLevel.DISK_ONLY)
    try:
        df.write.format(fmt).partitionBy(*parts).save(folder)
        written, found = df.count(), spark.read.format(fmt).schema(df.schema).load(folder).count()
        if found != written:
            raise RuntimeError(f"{found} rows in {folder}, {written} were written")
    except Exception:
        drop_folder(spark, folder)
        raise
    finally:
        if kept:
            df.unpersist()
    before = version_folder(spark, name)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({cols}) USING {fmt} {by} LOCATION '{folder}'")
    if parts:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    if before:
        drop_folder(spark, before)


def version_folder(spark: SparkSession, name: str) -> str | None:
    """The folder of a table that ``save_table`` wrote."""
    if not spark.catalog.tableExists(name):
        return None
    at = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return at["data_type"] if at and VERSION in at["data_type"] else None


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a table with its files."""
    folder = version_folder(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if folder:
        drop_folder(spark, folder)


def publish_ctas(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Replace a table by the rows of ``df``."""
    save_table(df, name, fmt)


def save_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "error", one_file: bool = False, sep: str = ",") -> None:
    """CSV with a header: a file per partition, or one file where the result is known to be small."""
    (df.coalesce(1) if one_file else df).write.mode(mode).csv(path, header=True, sep=sep)
