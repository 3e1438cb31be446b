import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskfeat.operators import models as M
from riskfeat.operators import prepare as P


@pytest.fixture(scope="module")
def data(spark):
    x = F.col("id") % 17
    df = spark.range(400).select(
        "id", x.cast("double").alias("a"), ((F.col("id") * 7) % 13).cast("double").alias("b"), F.when(x > 9, 1.0).otherwise(0.0).alias("label")
    )
    return P.assemble(df, ["a", "b"]).cache()


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, p double")
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for y, p in rows if y for z, q in rows if not z]
    r = M.auc(df, "label", "p").first()
    assert r["roc"] == pytest.approx(sum(pairs) / len(pairs))
    assert r["pr"] == pytest.approx(1 / 3 * (1 / 2 + 2 / 3 + 3 / 5))
    assert M.roc_points(df, "label", "p").count() == 4


def test_threshold_metrics_without_hits(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2), (0, 0.3)], "label int, p double")
    r = M.threshold_metrics(df, "label", "p").first()
    assert (r["recall"], r["precision"], r["f1"], r["roc"]) == (0.0, 0.0, 0.0, 0.5)
    assert r["average_precision"] == pytest.approx(1 / 3)


def test_models_learn_the_rule(spark, data):
    for model in (M.fit_rf(data), M.fit_dt(data), M.fit_gbt(data, rounds=3, depth=3)):
        got = M.threshold_metrics(model.transform(data), "label", M.probability_of(1), 0.5).first()
        assert got["accuracy"] == 1.0
    assert M.importances(M.fit_dt(data), data, 1).first()["feature"] == "a"
    assert {r["feature"] for r in M.coefficients(M.fit_lr(data), data).collect()} == {"a", "b", "intercept"}
    assert M.fit_linear_svc(data).transform(data).where("prediction = label").count() > 380


def test_weights_and_search(spark, data):
    weighted = M.class_weight(data, "label")
    sums = [r["s"] for r in weighted.groupBy("label").agg(F.sum("class_weight").alias("s")).collect()]
    assert sums == pytest.approx([200, 200])
    found = M.grid_search(data, LogisticRegression(), {"regParam": [0.01, 10.0]}, folds=2)
    assert found.bestModel.getOrDefault("regParam") == 0.01


def test_leaderboard(spark, data):
    train, test = data.where("id % 4 <> 0").drop("features"), data.where("id % 4 = 0").drop("features")
    board = M.leaderboard(
        train, test, ["a", "b"], "label", "id", {"tree": DecisionTreeClassifier(seed=1)}, samplings=("none", "down"), scalings=("none", "standard")
    )
    rows = board.collect()
    assert len(rows) == 4 and all(r["accuracy_test"] == 1.0 for r in rows)


def test_feature_ranking(spark, data):
    got = {r["feature"]: r["ranking"] for r in P.recursive_elimination(data.drop("features"), ["a", "b"], "label", 1).collect()}
    assert got == {"a": 1, "b": 2}
    assert P.select_k_best(data, ["a", "b"], "label", 1).first()["feature"] == "a"


def test_scoring_job(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "NA" if i % 5 == 0 else str(i), "Yes" if i % 2 else "No", f"c{i % 3}") for i in range(60)], "id int, x string, f string, c string"
    )
    raw.createOrReplaceTempView("raw_rows")
    config = {
        "input_table": "raw_rows", "output_table": "scored_rows", "model_path": str(tmp_path / "model"), "sentinel_columns": ["x"],
        "flags": {"f": "Yes"}, "casts": {"double": ["x"]}, "keep": ["id"],
    }
    train = M.cleanse(raw, config).withColumn("label", F.col("f").cast("double"))
    stages = [*P.index_strings(train, ["c"]).stages, VectorAssembler(inputCols=["x", "f", "c_idx"], outputCol="features"), RandomForestClassifier(seed=3)]
    M.save_model(Pipeline(stages=stages).fit(train), config["model_path"])
    unseen = raw.unionByName(spark.createDataFrame([(99, "NA", None, "new")], raw.schema))
    unseen.createOrReplaceTempView("raw_rows")
    out = M.score_job(spark, config)
    assert out.count() == 61 and out.where("prediction = 1").count() == 30
    spark.sql("drop table scored_rows")


def test_text_classifier_cuts_texts_once(spark, monkeypatch):
    """The fit and the scoring read stored vectors, not the texts."""
    from riskfeat.plans import models as plans

    seen = []
    monkeypatch.setattr(plans.M, "fit_lr", lambda df: seen.append(df))
    monkeypatch.setattr(plans.M, "score", lambda model, df, **_: df.withColumns({"prediction": F.lit(1.0), "p": F.lit(0.1)}))
    texts = spark.createDataFrame([(1, "good words", 1.0), (2, "bad words", 0.0), (3, "more words", None)], "doc_id bigint, text string, label double")
    monkeypatch.setattr(plans, "_labelled_texts", lambda s, d: texts)
    assert plans.text_classifier(spark, "").count() == 1
    assert "split(" not in seen[0]._jdf.queryExecution().toString()


def test_counted_trees_equal_trees_over_rows(spark, monkeypatch):
    """The same predictions as from all rows, while the rounds go through each row of bins and label once."""
    rng = np.random.default_rng(5)
    n = 3000
    x = np.where(rng.random(n) < 0.3, 0.0, rng.exponential(size=n)).round(2)
    z = rng.integers(0, 4, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x * (z - 1)))).astype(float)
    rows = [(i, float(a), float(b), 7.0, float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "id int, x double, z double, same double, label double")
    plain = M.fit_gbt(P.assemble(df, ["x", "z", "same"]), rounds=5, depth=3).transform(P.assemble(df, ["x", "z", "same"]))

    given, fit = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, data: (given.append(data.count()), fit(self, data))[1])
    counted = M.fit_gbt_counted(df, ["x", "z", "same"], rounds=5, depth=3).transform(df)
    assert given[0] <= 2 * 32 * 4
    p = lambda frame: {r["id"]: (r["prediction"], r["p"]) for r in frame.select("id", "prediction", M.probability_of(1).alias("p")).collect()}
    want, got = p(plain), p(counted)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and 0 < sum(v[0] for v in got.values()) < n
    assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()])


def test_split_points_follow_multiples_of_all_rows(spark):
    values = [0.0] * 400 + [float(v) for v in range(1, 60)] + [100.0] * 200 + [101.0, 102.0, 103.0]
    df = spark.createDataFrame([(v, float(i % 3), 1.0) for i, v in enumerate(values)], "a double, b double, c double")
    seen = sorted(set(values))
    want, rows, target = [], values.count(seen[0]), len(values) / 32
    for lo, hi in zip(seen, seen[1:]):
        if abs(rows - target) < abs(rows + values.count(hi) - target):
            want.append((lo + hi) / 2)
            target += len(values) / 32
        rows += values.count(hi)
    assert M.split_points(df, ["a", "b", "c"]) == {"a": want, "b": [0.5, 1.5], "c": []}
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="must be numbers"):
            M.split_points(spark.createDataFrame([(1.0,), (bad,)], "a double"), ["a"])
