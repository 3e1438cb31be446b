"""Sampling, neighbours, models and their evaluation over the test tables."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskfeat.functions import text as X
from riskfeat.functions.fixed_values import STOP_WORDS
from riskfeat.operators import joins as J
from riskfeat.operators import models as M
from riskfeat.operators import neighbours as N
from riskfeat.operators import prepare as P
from riskfeat.operators import sampling as K
from riskfeat.operators import sweeps as W
from riskfeat.operators import vocabulary as V
from riskfeat.plans.base import FEATURES, load, query, r6, with_holes
from riskfeat.plans.columns import _scratch
from riskfeat.runtime import cut_lineage, stored
from riskfeat.sources.sinks import drop_table

# --- samples ----------------------------------------------------------------------------------

FLAGGED_SQL = "flagged AS (SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders)"


def flagged(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label"),
    )


def _sizes(df):
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("sample_without_replacement")
def sample_without_replacement(spark, d):
    return K.sample(flagged(spark, d), 0.2, seed=123)


@query("sample_with_replacement")
def sample_with_replacement(spark, d):
    return K.sample(flagged(spark, d), 1.5, replace=True, seed=3)


@query("random_split", f"WITH {FLAGGED_SQL} SELECT count(*) AS n FROM flagged")
def random_split(spark, d):
    a, b = K.split_random(flagged(spark, d), [0.8, 0.2], 111)
    return a.unionByName(b).agg(F.count(F.lit(1)).alias("n"))


@query("split_by_id", f"WITH {FLAGGED_SQL} SELECT o_orderkey, label FROM flagged")
def split_by_id(spark, d):
    train, test = K.split_by_id(flagged(spark, d), ["o_orderkey"], 0.2, drop=["month", "o_totalprice"])
    return train.unionByName(test)


@query(
    "time_split",
    f"""WITH {FLAGGED_SQL} SELECT o_orderkey, label, 'train' AS part FROM flagged WHERE month < '1998-01'
        UNION ALL SELECT o_orderkey, label, 'test' FROM flagged WHERE month >= '1998-01' AND month < '1998-05'""",
)
def time_split(spark, d):
    train, test = K.split_time(flagged(spark, d).drop("o_totalprice"), "month", "1998-01", "1998-05")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("downsampled_sizes", f"WITH {FLAGGED_SQL} SELECT v.label, (SELECT sum(label) FROM flagged)::BIGINT AS n FROM (VALUES (0), (1)) v(label)")
def downsampled_sizes(spark, d):
    return _sizes(K.downsample(flagged(spark, d), "label", ["o_orderkey"]))


@query("downsampled_rows")
def downsampled_rows(spark, d):
    return K.downsample(flagged(spark, d), "label", ["o_orderkey"], ratio=2)


@query("upsampled_sizes", f"WITH {FLAGGED_SQL} SELECT v.label, (SELECT sum(1 - label) FROM flagged)::BIGINT AS n FROM (VALUES (0), (1)) v(label)")
def upsampled_sizes(spark, d):
    return _sizes(K.upsample(flagged(spark, d), "label", ["o_orderkey"]))


@query("balanced_sample")
def balanced_sample(spark, d):
    return K.balance(flagged(spark, d), "label", {0: 0.25, 1: 1.0})


@query("holdout_complement", f"WITH {FLAGGED_SQL} SELECT o_orderkey FROM flagged")
def holdout_complement(spark, d):
    df = flagged(spark, d)
    train = K.sample(df, 0.7, seed=5)
    return K.holdout(df, train, ["o_orderkey"]).unionByName(train).select("o_orderkey")


VEC_COLS = [f"x{i}" for i in range(64)]


def vectors(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(
        "vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VEC_COLS)],
    )


VEC_SQL = "vecs AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
# Distances are summed in the order of the dimensions on both sides.
DIST = "sqrt(list_sum(list_transform(range(1, {n} + 1), lambda i: (a.{v}[i] - b.{v}[i]) * (a.{v}[i] - b.{v}[i]))))"


@query(
    "nearest_neighbours",
    f"""WITH {VEC_SQL} SELECT id, rank, neighbour, round(distance, 6) AS distance FROM (
          SELECT a.vec_id AS id, b.vec_id AS neighbour, {DIST.format(n=64, v='v')} AS distance,
                 CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST.format(n=64, v='v')}, b.vec_id) AS INTEGER) AS rank
          FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def nearest_neighbours(spark, d):
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), F.array(*VEC_COLS).alias("features"))
    return N.nearest(v, 5).withColumn("distance", r6("distance"))


@query("smote_sizes", f"WITH {VEC_SQL} SELECT v.label, (SELECT sum(1 - label) FROM vecs)::BIGINT AS n FROM (VALUES (0), (1)) v(label)")
def smote_sizes(spark, d):
    return _sizes(K.smote(vectors(spark, d), VEC_COLS, "label", "vec_id"))


@query("smote_rows")
def smote_rows(spark, d):
    return K.smote(vectors(spark, d), VEC_COLS, "label", "vec_id").where("synthetic")


@query(
    "edited_neighbours",
    f"""WITH {VEC_SQL}, near AS (SELECT * FROM (SELECT a.vec_id, a.label, b.label AS other,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST.format(n=64, v='v')}, b.vec_id) AS rn FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rn <= 3)
        SELECT vec_id, label FROM vecs WHERE vec_id NOT IN (SELECT vec_id FROM near WHERE label = 0 AND other <> label)""",
)
def edited_neighbours(spark, d):
    return K.edited_neighbours(vectors(spark, d), VEC_COLS, "label", "vec_id").select("vec_id", "label")


@query("smote_then_edit")
def smote_then_edit(spark, d):
    return _sizes(K.smote_enn(vectors(spark, d), VEC_COLS, "label", "vec_id"))


# --- evaluation -------------------------------------------------------------------------------

SCORED_SQL = "scored AS (SELECT event_id, CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND value > 20) THEN 1 ELSE 0 END AS label, value / (1 + value) AS p FROM events)"


def scored(spark, d):
    bought = (F.col("event_type") == "purchase") | ((F.col("event_type") == "click") & (F.col("value") > 20))
    return load(spark, d, "events").select("event_id", F.when(bought, 1).otherwise(0).alias("label"), (F.col("value") / (F.col("value") + 1)).alias("p"))


CURVE_SQL = f"""{SCORED_SQL}, s AS (SELECT p AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(label) FROM scored) AS ap, (SELECT sum(1 - label) FROM scored) AS an FROM s WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", f"WITH {CURVE_SQL} SELECT round(score, 6) AS score, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr FROM c")
def roc_curve(spark, d):
    return M.roc_points(scored(spark, d), "label", "p").select(*[r6(c).alias(c) for c in ("score", "fpr", "tpr")])


@query("precision_recall_curve", f"WITH {CURVE_SQL} SELECT round(score, 6) AS score, round(tp / ap, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c")
def precision_recall_curve(spark, d):
    return M.pr_points(scored(spark, d), "label", "p").select(*[r6(c).alias(c) for c in ("score", "recall", "precision")])


@query(
    "area_under_curves",
    f"WITH {CURVE_SQL} SELECT round(sum(neg * (tp - pos + pos / 2.0)) / (max(ap) * max(an)), 6)::DOUBLE AS roc, round(sum(pos * tp / (tp + fp)) / max(ap), 6)::DOUBLE AS pr FROM c",
)
def area_under_curves(spark, d):
    return M.auc(scored(spark, d), "label", "p").select(r6("roc").alias("roc"), r6("pr").alias("pr"))


@query("confusion_matrix", f"WITH {SCORED_SQL} SELECT label, CASE WHEN p > 0.9 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return M.confusion(scored(spark, d).withColumn("hit", F.when(F.col("p") > 0.9, 1).otherwise(0)), "label", "hit")


@query(
    "cutoff_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (p > 0.9 AND label = 1) AS tp, count(*) FILTER (p > 0.9 AND label = 0) AS fp,
          count(*) FILTER (NOT p > 0.9 AND label = 0) AS tn, count(*) FILTER (NOT p > 0.9 AND label = 1) AS fn FROM scored),
        r AS (SELECT *, tp / (tp + fn)::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS prec, tn / (tn + fp)::DOUBLE AS spec, (tp + fp + tn + fn)::DOUBLE AS n FROM c)
        SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(rec, 6) AS recall, round(prec, 6) AS precision, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1,
          round(rec * prec + (1 - rec) * (tp + fn) / n, 6) AS average_precision, round((rec + spec) / 2, 6) AS roc FROM r""",
)
def cutoff_metrics(spark, d):
    m = M.threshold_metrics(scored(spark, d), "label", "p", 0.9)
    return m.withColumns({c: r6(c) for c in ("accuracy", "recall", "precision", "f1", "average_precision", "roc")})


@query(
    "class_weights",
    f"WITH {FLAGGED_SQL} SELECT label, round((SELECT count(*) FROM flagged) / (2.0 * count(*)), 6)::DOUBLE AS class_weight, count(*) AS n FROM flagged GROUP BY label",
)
def class_weights(spark, d):
    w = M.class_weight(flagged(spark, d), "label")
    return w.groupBy("label", r6("class_weight").alias("class_weight")).agg(F.count(F.lit(1)).alias("n"))


@query("label_over_time", "SELECT strftime(o_orderdate, '%Y') AS year, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def label_over_time(spark, d):
    return M.target_over_time(load(spark, d, "orders"), "o_orderdate", "o_orderstatus")


# --- models -----------------------------------------------------------------------------------


def features(spark, d):
    return P.assemble(P.fill_zero(with_holes(spark, d)), FEATURES).withColumn("label", F.col("label").cast("double"))


def _predictions(model, df):
    return model.transform(df).select("l_orderkey", "label", "prediction")


@query("logistic_model")
def logistic_model(spark, d):
    df = features(spark, d)
    return M.fit_lr(df).transform(df).select("l_orderkey", "label", "prediction", M.probability_of(1).alias("p1"))


@query("model_coefficients")
def model_coefficients(spark, d):
    df = features(spark, d)
    return M.coefficients(M.fit_lr(df), df)


@query("forest_importances")
def forest_importances(spark, d):
    df = features(spark, d)
    return M.importances(M.fit_rf(df, bins=16), df, 10)


@query("entropy_tree_model")
def entropy_tree_model(spark, d):
    df = M.class_weight(features(spark, d), "label", {0: 1, 1: 2})
    return _predictions(M.fit_dt(df, weight="class_weight", depth=5), df)


@query("boosted_model")
def boosted_model(spark, d):
    df = P.fill_zero(with_holes(spark, d)).withColumn("label", F.col("label").cast("double"))
    return _predictions(M.fit_gbt_counted(df, FEATURES, rounds=100, depth=3), df)


@query("linear_vector_model")
def linear_vector_model(spark, d):
    df = features(spark, d)
    return _predictions(M.fit_linear_svc(df), df)


@query("grid_search")
def grid_search(spark, d):
    """Mean area on three held-out folds for penalties, their absolute share and class weights."""
    df = P.fill_zero(with_holes(spark, d))
    points = W.grid([0.001, 0.01, 0.1, 1.0], [0.0, 0.5], [(1.0, 1.0), "balanced"])
    found = W.logistic_sweep(df, FEATURES, "label", ["l_orderkey"], points, folds=3)
    rows = [(i, c.reg, c.mixing, "balanced" if c.weights == "balanced" else "equal") for i, c in enumerate(points)]
    table = spark.createDataFrame(rows, "candidate int, reg double, mixing double, weights string")
    return table.join(found.areas.groupBy("candidate").agg(F.avg("area").alias("area")), "candidate")


@query("prediction_errors")
def prediction_errors(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    level = F.substring("o_orderpriority", 1, 1).cast("double")
    df = orders.withColumns({"level": level, "label": F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)})
    df = P.assemble(df, ["o_totalprice", "level"])
    predicted = M.fit_dt(df, depth=4).transform(df)
    return J.prediction_errors(J.attach_predictions(orders, predicted, "o_orderkey", ["label", "prediction"]))


@query("model_leaderboard")
def model_leaderboard(spark, d):
    train, test = K.split_by_id(vectors(spark, d), ["vec_id"], 0.2)
    models = {
        "tree": DecisionTreeClassifier(impurity="entropy", seed=1), "forest": RandomForestClassifier(numTrees=5, seed=1),
    }
    return M.leaderboard(
        train.cache(), test.cache(), VEC_COLS, "label", "vec_id", models, samplings=("up", "smote"), scalings=("none", "minmax"),
        grids={"tree": {"maxDepth": [3, 5]}}, folds=2,
    )


def _labelled_texts(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return docs.join(load(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id", "left")


@query("text_classifier")
def text_classifier(spark, d):
    texts = X.tokenize(_labelled_texts(spark, d), "text", "words")
    words = X.remove_stopwords(X.computed_once(texts, ["doc_id", "label"], words=F.col("words")), "words", "kept", STOP_WORDS)
    # Cut once for the dictionary, the counts and the vectors; the vectors are read by every pass of the fit and by the scoring.
    words = stored(words.select("doc_id", "label", "kept"), "kept-words")
    # The dictionary is that of the labelled texts, whatever its size.
    terms = V.dictionary(V.term_counts(words.where(F.col("label").isNotNull()), "doc_id", "kept"))
    full = stored(V.term_features(words, "doc_id", "kept", terms).select("doc_id", "label", "features"), "term-features")
    fitted = M.fit_lr(full.where(F.col("label").isNotNull()))
    return M.score(fitted, full.where(F.col("label").isNull()), cls=0, at_most=0.5).select("doc_id", "prediction", "p")


@query("scoring_job")
def scoring_job(spark, d):
    raw = load(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("done"),
    )
    view = f"scoring_input_{uuid.uuid4().hex}"
    raw.createOrReplaceTempView(view)
    path = _scratch(spark)
    config = {
        "input_table": view, "output_table": f"risk_scores_{uuid.uuid4().hex}", "model_path": path,
        "sentinel_columns": ["price"], "flags": {"done": "Yes"}, "casts": {"double": ["price"]}, "keep": ["o_orderkey"],
    }
    train = M.cleanse(raw, config).withColumn("label", F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
    indexers = P.index_strings(train, ["o_orderpriority"])
    stages = [*indexers.stages, VectorAssembler(inputCols=["price", "done", "o_orderpriority_idx"], outputCol="features"),
              RandomForestClassifier(numTrees=10, maxDepth=5, seed=7)]
    M.save_model(Pipeline(stages=stages).fit(train), path)
    scored = cut_lineage(M.score_job(spark, config))
    drop_table(spark, config["output_table"])
    spark.catalog.dropTempView(config["input_table"])
    return scored


@query(
    "cached_repartitioned_join",
    """SELECT o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def cached_repartitioned_join(spark, d):
    from riskfeat.plans.base import money

    # As many partitions as the session's shuffles have, and the cache is given back.
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey").cache()
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice").repartition("o_orderkey")
    totals = cut_lineage(li.join(o, "o_orderkey").groupBy("o_custkey").agg(money("l_extendedprice").alias("total")))
    o.unpersist()
    return totals


