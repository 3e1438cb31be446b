"""Chunked windows give what a plain window gives, with one group in many chunks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskfeat.operators.ordered import number_rows, running_totals, with_neighbours


def skewed(spark):
    # A third of the rows belong to key 0, one key is null.
    return spark.range(900).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 7 + 1).alias("k"),
        ((F.col("id") * 7919) % 997).alias("v"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_row_number_with_hot_key(spark):
    df = skewed(spark)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")).cast("bigint"))
    got = number_rows(df, ["k"], [F.desc("v"), "id"], "rn")
    assert rows(got.select("id", "k", "v", "rn")) == rows(want)


def test_row_number_over_whole_table(spark):
    df = skewed(spark)
    got = number_rows(df, [], ["v", "id"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")).cast("bigint"))
    assert rows(got.select("id", "k", "v", "rn")) == rows(want)


def test_equal_rows_are_numbered_once_each(spark):
    copies = spark.range(500).select(F.lit("same").alias("x"))
    got = number_rows(copies, [], ["x"], "rn")
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 501))


def test_neighbours_across_chunks(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = df.select("id", F.lag("v").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    got = with_neighbours(df, ["k"], ["v", "id"], ["v", "id"])
    assert rows(got.select("id", F.col("prev.v").alias("p"), F.col("next.id").alias("n"))) == rows(want)


def test_null_payload_is_kept_apart_from_missing_neighbour(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"), F.lit(1).alias("k"))
    w = Window.partitionBy("k").orderBy("id")
    want = df.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    got = with_neighbours(df, ["k"], ["id"], ["v"])
    assert rows(got.select("id", F.col("prev.v").alias("p"), F.col("next.v").alias("n"))) == rows(want)


def test_running_totals_across_chunks(spark):
    df = skewed(spark).groupBy("k", "v").agg(F.sum("id").alias("x"), F.count("*").alias("c"))
    w = Window.partitionBy("k").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "v", F.sum("x").over(w).alias("sx"), F.sum("c").over(w).alias("sc"))
    got = running_totals(df, ["k"], [F.desc("v")], {"sx": "x", "sc": "c"})
    assert rows(got.select("k", "v", "sx", "sc")) == rows(want)
