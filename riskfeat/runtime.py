"""Small helpers shared by the operators: lineage cuts, size checks, bounded reads."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rows that one broadcast may hold.
BROADCAST_ROWS = 100_000


_shipped: set[str] = set()
_folders: list[str] = []


def in_one_process(spark: SparkSession) -> bool:
    """True for local[...] sessions, whose driver and executors are the same process."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that functions run in their Python find it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="riskfeat-ship-"), "riskfeat.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder; it is deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    _folders.append(path)
    return path


def new_folders(since: int = 0) -> list[str]:
    """Shared folders made by this process, in order, from the given number on."""
    return _folders[since:]


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str = "stored", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/rows"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's, else a fresh one when Spark runs in one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="riskfeat-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later steps see the same rows after an executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly column work when the input comes in fewer partitions than that.

    A table of some size has more partitions than the cluster has cores, and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; stops reading just beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the row count was checked; otherwise leave the join to Spark."""
    return F.broadcast(df) if at_most(df, rows) else df


def collect_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> list[Row]:
    """Bring a result of known small size (edges, counts per feature) to the driver, or fail."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"expected at most {rows} rows, got more")
    return got


def same(left: list[str], a: str = "a", b: str = "b"):
    """Null-safe equality of key columns of two aliased tables."""
    cond = F.lit(True)
    for k in left:
        cond = cond & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return cond
