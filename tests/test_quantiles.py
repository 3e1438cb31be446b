import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfeat.operators.quantiles import exact_quantiles, quantile_rows

QS = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.99, 1.0]


def frame(spark, values):
    data = [(k, float(v) if v is not None else None) for k, vs in values.items() for v in vs]
    return spark.createDataFrame(data, "feature string, value double").repartition(4)


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=1500),
        "mostly_zero": np.where(rng.random(1200) < 0.6, 0.0, rng.exponential(size=1200)),
        "few": rng.integers(0, 5, 900).astype(float),
        "constant": np.full(700, 3.5),
        "tiny": np.array([1.0, 2.0]),
    }
    df = frame(spark, values).unionByName(
        spark.createDataFrame([("normal", None), ("normal", float("nan")), ("none", None)], "feature string, value double")
    )
    got = exact_quantiles(df, ["feature"], "value", QS)
    assert set(got) == {(k,) for k in values}
    for k, v in values.items():
        assert [got[(k,)][q] for q in QS] == pytest.approx(list(np.quantile(v, QS)), abs=1e-12)


def test_without_keys(spark):
    df = spark.range(1000).select(F.col("id").alias("value"))
    got = exact_quantiles(df, [], "value", [0.25, 0.5])
    assert got[()] == pytest.approx({0.25: 249.75, 0.5: 499.5})


def test_empty(spark):
    assert exact_quantiles(spark.createDataFrame([], "value double"), [], "value", [0.5]) == {}


def test_many_keys(spark):
    """A thousand keys, so edges for features, fills and segments together."""
    df = spark.range(40_000).select((F.col("id") % 1000).alias("k"), (F.col("id") % 97).cast("double").alias("value"))
    got = quantile_rows(df, ["k"], "value", [0.0, 0.5, 1.0])
    assert got.count() == 1000
    values = [float((7 + 1000 * i) % 97) for i in range(40)]
    assert got.where("k = 7").first()["quantiles"] == pytest.approx(list(np.quantile(values, [0, 0.5, 1])))
