"""Models on Spark ML: fitting, tuning, evaluation at any size, scoring."""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, Bucketizer, CountVectorizer, HashingTF, MinMaxScaler, NGram, RegexTokenizer, StandardScaler, StopWordsRemover, Tokenizer,
    VectorAssembler, Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.functions.columns import cast_columns, flag, sentinel_to_null
from riskfeat.functions.fixed_values import DECISION_LIMIT, STOP_WORDS
from riskfeat.operators import sampling
from riskfeat.operators.ordered import running_totals
from riskfeat.operators.stats import long_features
from riskfeat.operators.vocabulary import join_hot
from riskfeat.runtime import spread, stored
from riskfeat.sources.sinks import publish_ctas


def probability_of(cls: int = 1, col: str = "probability") -> Column:
    """Probability of one class as a number, without a Python worker."""
    return vector_to_array(F.col(col))[cls]


# --- text features ----------------------------------------------------------------------------


def count_vectorize(words: str, out: str = "counts", vocab: int = 1 << 18, min_df: float = 1.0) -> CountVectorizer:
    return CountVectorizer(inputCol=words, outputCol=out, vocabSize=vocab, minDF=min_df)


def hash_tf(words: str, out: str = "tf", features: int = 1 << 18) -> HashingTF:
    return HashingTF(inputCol=words, outputCol=out, numFeatures=features)


def idf(counts: str, out: str = "idf", min_docs: int = 0) -> IDF:
    return IDF(inputCol=counts, outputCol=out, minDocFreq=min_docs)


def word2vec(words: str, out: str = "w2v", size: int = 100, min_count: int = 5, seed: int = 42, partitions: int = 1) -> Word2Vec:
    return Word2Vec(inputCol=words, outputCol=out, vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions)


def whitespace_tokenizer(src: str, out: str = "words") -> Tokenizer:
    return Tokenizer(inputCol=src, outputCol=out)


def ngram_stage(words: str, n: int, out: str = "ngrams") -> NGram:
    return NGram(n=n, inputCol=words, outputCol=out)


def text_stages(
    text: str, stop_words: Sequence[str] = STOP_WORDS, vocab: int = 1 << 18, min_df: float = 1.0,
    vector_size: int = 100, min_count: int = 5, inputs: Sequence[str] = ("counts",), w2v_partitions: int = 1,
) -> Pipeline:
    """Tokens, stop words, counts, document-frequency weights, embeddings; ``inputs`` become features."""
    stages: list = [
        RegexTokenizer(inputCol=text, outputCol="words", minTokenLength=2, pattern="\\W"),
        StopWordsRemover(inputCol="words", outputCol="filtered", stopWords=list(stop_words), locale="en_US"),
        count_vectorize("filtered", "counts", vocab, min_df),
        idf("counts", "idf"),
    ]
    if "w2v" in inputs:
        stages.append(word2vec("filtered", "w2v", vector_size, min_count, partitions=w2v_partitions))
    stages.append(VectorAssembler(inputCols=list(inputs), outputCol="features"))
    return Pipeline(stages=stages)


def text_pipeline(train: DataFrame, full: DataFrame, text: str, **options) -> tuple[PipelineModel, DataFrame]:
    """Fit on the labelled source, apply to the union of both."""
    model = text_stages(text, **options).fit(train)
    return model, model.transform(full)


# --- classifiers ------------------------------------------------------------------------------


def _common(label: str, features: str, weight: str | None) -> dict:
    args = {"labelCol": label, "featuresCol": features}
    if weight:
        args["weightCol"] = weight
    return args


def fit_lr(df: DataFrame, label: str = "label", features: str = "features", weight: str | None = None, max_iter: int = 10) -> Model:
    return LogisticRegression(maxIter=max_iter, **_common(label, features, weight)).fit(df)


def fit_rf(df, label="label", features="features", weight=None, trees=10, depth=5, bins=32, seed=42) -> Model:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, **_common(label, features, weight)).fit(df)


def fit_dt(df, label="label", features="features", weight=None, depth=8, impurity="entropy", seed=42) -> Model:
    return DecisionTreeClassifier(maxDepth=depth, impurity=impurity, seed=seed, **_common(label, features, weight)).fit(df)


def fit_gbt(df, label="label", features="features", weight=None, rounds=100, depth=8, step=0.1, seed=41) -> Model:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **_common(label, features, weight)).fit(df)


def split_points(df: DataFrame, cols: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Per column the thresholds that Spark's trees try, found on all rows and not on a sample.

    Up to ``bins`` distinct values are all parted.  Of more, a value begins a new bin as soon as the rows before it
    come nearer to the next multiple of rows / ``bins`` than the rows up to it.
    """
    counts = stored(long_features(df, [], cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    value = F.col("value")
    if not counts.where(value.isNull() | F.isnan("value") | (F.abs("value") == math.inf)).isEmpty():
        raise ValueError("tree features must be numbers: found a null, NaN or infinite value")
    summed = stored(running_totals(counts, ["feature"], ["value"], {"to": "n", "at": F.lit(1).cast("bigint")}), "value-ranks")
    sizes = {r["feature"]: (r["rows"], r["values"]) for r in summed.groupBy("feature").agg(F.max("to").alias("rows"), F.max("at").alias("values")).collect()}
    table = df.sparkSession.createDataFrame([(f, rows) for f, (rows, _) in sizes.items()], "feature string, rows bigint")
    # How many multiples lie below the middle of the rows before a value and those up to it.
    passed = lambda both: F.floor((F.lit(bins) * both - 1) / (2 * F.col("rows")))
    before = F.col("to") - F.col("n")
    jumps = summed.join(F.broadcast(table), "feature").where(F.col("at") > 1).select("feature", "at", passed(before + F.col("to")).alias("reached"))
    # For each multiple the first value beyond it: at most ``bins`` rows per feature.
    first = jumps.withColumn("multiple", F.explode(F.sequence(F.lit(1), F.lit(bins)))).where(F.col("reached") >= F.col("multiple"))
    firsts = first.groupBy("feature", "multiple").agg(F.min("at").alias("at")).collect()
    starts: dict[str, list[int]] = {}
    for f, (_, values) in sizes.items():
        if values <= bins:
            starts[f] = list(range(2, values + 1))
            continue
        # One bin begins per value, so a value that passes several multiples leaves the others to the next values.
        starts[f] = []
        for _, at in sorted((r["multiple"], r["at"]) for r in firsts if r["feature"] == f):
            at = max(at, starts[f][-1] + 1) if starts[f] else at
            if at <= values:
                starts[f].append(at)
    ends = [(f, at) for f, begun in starts.items() for at in sorted({x for b in begun for x in (b - 1, b)})]
    wanted = F.broadcast(df.sparkSession.createDataFrame(ends, "feature string, at bigint"))
    held = {(r["feature"], r["at"]): r["value"] for r in summed.join(wanted, ["feature", "at"]).select("feature", "at", "value").collect()}
    return {f: [(held[f, at - 1] + held[f, at]) / 2 for at in starts.get(f, [])] for f in cols}


def fit_gbt_counted(df, cols: Sequence[str], label="label", rounds=100, depth=8, step=0.1, seed=41, bins=32) -> PipelineModel:
    """Boosted trees as ``fit_gbt`` grows them, over the counts of equal rows of bins.

    Trees see a row only by the bins of its columns and its label, so rows alike in these are one row with their number as
    weight: at most 2 × ``bins`` ** columns rows, however long the table, are gone through in each round.
    """
    inner = split_points(df, cols, bins)
    # Buckets are [a, b); trees keep a value that equals the threshold on its left.  A constant column gets an edge beyond it.
    edges = [sorted({-math.inf, math.inf, *(math.nextafter(t, math.inf) for t in inner[c])}) for c in cols]
    edges = [e if len(e) > 2 else [-math.inf, sys.float_info.max, math.inf] for e in edges]
    names = [f"_bin_{i}" for i in range(len(cols))]
    cut = Bucketizer(splitsArray=edges, inputCols=list(cols), outputCols=names, handleInvalid="error")
    gather = VectorAssembler(inputCols=names, outputCol="_bins")
    # The numbers of bins are in order; without the bucketizer's notes on them trees do not take them for categories.
    plain = [F.col(n).alias(n, metadata={}) for n in names]
    alike = stored(cut.transform(df).select(*plain, label).groupBy(*names, label).agg(F.count(F.lit(1)).cast("double").alias("_weight")), "alike")
    # Spark looks for bins in max(10000, maxBins ** 2) rows: here in all of them.
    every = max(bins, math.isqrt(alike.count()) + 1)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxBins=every, **_common(label, "_bins", "_weight"))
    fitted = trees.fit(gather.transform(spread(alike)))
    return PipelineModel(stages=[cut, gather, fitted])


def fit_linear_svc(df: DataFrame, label: str = "label", features: str = "features", max_iter: int = 50) -> Model:
    """Linear support vectors with balanced class weights."""
    weighted = class_weight(df, label, "balanced")
    return LinearSVC(labelCol=label, featuresCol=features, weightCol="class_weight", maxIter=max_iter).fit(weighted)


def class_weight(df: DataFrame, label: str, weights: Mapping | str = "balanced", out: str = "class_weight") -> DataFrame:
    """Weight per row by class: as given, or rows / (classes × rows of the class).  Rows without class have none."""
    if weights == "balanced":
        sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
        whole = sizes.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
        table = sizes.withColumn(out, F.lit(float(whole["rows"] or 0)) / (F.lit(whole["classes"]) * F.col("_n")))
        known = join_hot(df.where(F.col(label).isNotNull()), table, label, "_n").drop("_n")
        return known.unionByName(df.where(F.col(label).isNull()).withColumn(out, F.lit(None).cast("double"))).select(*df.columns, out)
    chain = reduce(lambda w, kv: w.when(F.col(label) == F.lit(kv[0]), F.lit(float(kv[1]))), list(weights.items())[1:],
                   F.when(F.col(label) == F.lit(next(iter(weights))), F.lit(float(next(iter(weights.values()))))))
    return df.withColumn(out, chain)


def grid_search(df: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], folds: int = 3, metric: str = "areaUnderROC", label: str = "label", seed: int = 42, parallel: int = 2):
    """Cross-validated search over named parameters of the estimator."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    if metric.startswith("area"):
        judge = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    else:
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=parallel)
    return search.fit(df)


# --- evaluation -------------------------------------------------------------------------------


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; equal scores are merged before any shuffle."""
    y = F.col(label).cast("int")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def curve_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp): true and false positives when everything from this score up is chosen."""
    return running_totals(score_counts(df, label, score), [], [F.desc("score")], {"tp": "pos", "fp": "neg"})


def _with_totals(points: DataFrame) -> DataFrame:
    whole = points.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return points.withColumns({"_p": whole.getField("p"), "_n": whole.getField("n")})


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, fpr, tpr), one point per distinct score."""
    points = _with_totals(curve_counts(df, label, score))
    return points.select("score", F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, recall, precision)."""
    points = _with_totals(curve_counts(df, label, score))
    return points.select("score", F.try_divide("tp", "_p").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(roc, pr): area under the ROC curve with half credit for ties, and average precision."""
    points = _with_totals(curve_counts(df, label, score))
    tp_before = F.col("tp") - F.col("pos")
    half = F.col("neg") * (tp_before + F.col("pos") / 2)
    step = F.col("pos") * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    return points.agg(
        F.try_divide(F.sum(half), F.max("_p").cast("double") * F.max("_n")).alias("roc"),
        F.try_divide(F.sum(step), F.max("_p")).alias("pr"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def threshold_metrics(df: DataFrame, label: str, probability: Column | str, limit: float = DECISION_LIMIT) -> DataFrame:
    """Metrics of the decisions probability > limit; ROC area and average precision are those of the
    0/1 decisions."""
    p = F.col(probability) if isinstance(probability, str) else probability
    chosen, y = p > limit, F.col(label).cast("int")
    c = df.agg(
        F.count_if(chosen & (y == 1)).alias("tp"), F.count_if(chosen & (y == 0)).alias("fp"),
        F.count_if(~chosen & (y == 0)).alias("tn"), F.count_if(~chosen & (y == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    zero = F.lit(0.0)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    specificity = F.coalesce(F.try_divide(tn, tn + fp), zero)
    return c.select(
        "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, n).alias("accuracy"), recall.alias("recall"), precision.alias("precision"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        (recall * precision + (1 - recall) * F.try_divide(tp + fn, n)).alias("average_precision"),
        ((recall + specificity) / 2).alias("roc"),
    )


def target_over_time(df: DataFrame, ts: str, label: str, unit: str = "year") -> DataFrame:
    from riskfeat.functions.columns import date_part_text

    return df.groupBy(date_part_text(F.col(ts), unit).alias(unit), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- model inspection -------------------------------------------------------------------------


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the vector's slots as the assembler recorded them."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = [a for group in attrs.values() for a in group]
    return [a.get("name", str(a["idx"])) for a in sorted(slots, key=lambda a: a["idx"])]


def importances(model: Model, df: DataFrame, n: int | None = None, features: str = "features") -> DataFrame:
    """(feature, importance), highest first."""
    values = model.featureImportances.toArray()
    names = feature_names(df, features) or [str(i) for i in range(len(values))]
    table = df.sparkSession.createDataFrame([(a, float(v)) for a, v in zip(names, values)], "feature string, importance double")
    ranked = table.orderBy(F.desc("importance"), "feature")
    return ranked if n is None else ranked.limit(n)


def coefficients(model: Model, df: DataFrame, features: str = "features") -> DataFrame:
    """(feature, coefficient), the intercept included."""
    values = model.coefficients.toArray()
    names = feature_names(df, features) or [str(i) for i in range(len(values))]
    rows = [(a, float(v)) for a, v in zip(names, values)] + [("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


# --- sweep and scoring ------------------------------------------------------------------------


def _resampled(train: DataFrame, how: str, cols: Sequence[str], label: str, row_id: str) -> DataFrame:
    if how == "none":
        return train.select(*cols, label)
    if how == "up":
        return sampling.upsample(train, label, [row_id]).select(*cols, label)
    if how == "down":
        return sampling.downsample(train, label, [row_id]).select(*cols, label)
    if how == "smote":
        return sampling.smote(train, cols, label, row_id).select(*cols, label)
    if how == "smote_enn":
        return sampling.smote_enn(train, cols, label, row_id).select(*cols, label)
    raise ValueError(f"unknown sampling {how}")


def _scaler(how: str) -> list:
    if how == "none":
        return []
    if how == "minmax":
        return [MinMaxScaler(inputCol="_raw", outputCol="features")]
    if how == "standard":
        return [StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]
    raise ValueError(f"unknown scaling {how}")


def leaderboard(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, row_id: str,
    models: Mapping[str, Estimator], samplings: Sequence[str] = ("up", "down", "smote"),
    scalings: Sequence[str] = ("none", "minmax", "standard"), grids: Mapping[str, Mapping] | None = None,
    folds: int = 3, limit: float = DECISION_LIMIT,
) -> DataFrame:
    """One row per sampling × model × scaling with train and test metrics at the cut-off.

    Trees take ``labelCol`` from ``label``.  With ``grids`` each fit is a cross-validated search.
    """
    results = []
    for how in samplings:
        rows = _resampled(train, how, cols, label, row_id).persist()
        for name, estimator in models.items():
            for scaling in scalings:
                raw = "_raw" if scaling != "none" else "features"
                prepare = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol=raw), *_scaler(scaling)]).fit(rows)
                clf = estimator.copy({estimator.labelCol: label, estimator.featuresCol: "features"})
                data = prepare.transform(rows)
                best = "{}"
                if grids and name in grids:
                    found = grid_search(data, clf, grids[name], folds, "accuracy", label)
                    fitted = found.bestModel
                    best = str({p: fitted.getOrDefault(p) for p in sorted(grids[name])})
                else:
                    fitted = clf.fit(data)
                got = {}
                for part, frame in (("train", train), ("test", test)):
                    scored = fitted.transform(prepare.transform(frame)).withColumn("_p", probability_of(1))
                    m = threshold_metrics(scored, label, "_p", limit)
                    # One row of metrics: fixed size whatever the table's.
                    kept = m.select("recall", "average_precision", "accuracy", "f1", "roc").first().asDict()
                    got.update({f"{c}_{part}": v for c, v in kept.items()})
                top = "[]"
                if hasattr(fitted, "featureImportances"):
                    order = sorted(zip(fitted.featureImportances.toArray(), cols), reverse=True)[:10]
                    top = str([c for _, c in order])
                tags = {"sampling": how, "model": name, "scaling": scaling, "best_parameters": best, "important_features": top}
                results.append({**tags, **got})
        rows.unpersist()
    names = list(results[0])
    schema = ", ".join(f"{n} {'string' if isinstance(results[0][n], str) else 'double'}" for n in names)
    return train.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in results], schema)


def score(model: PipelineModel | Model, df: DataFrame, cls: int = 0, at_most: float | None = 0.5, only_positive: bool = True) -> DataFrame:
    """Predictions with the chosen class's probability; by default rows predicted 1 with p(0) ≤ 0.5."""
    scored = model.transform(df).withColumn("p", probability_of(cls))
    if only_positive:
        scored = scored.where(F.col("prediction") == 1.0)
    return scored if at_most is None else scored.where(F.col("p") <= at_most)


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cleanse(df: DataFrame, config: Mapping) -> DataFrame:
    """Sentinel to null, yes/no columns to 1/0, casts, missing numbers to 0 – as the config lists them."""
    df = sentinel_to_null(df, config.get("sentinel_columns", []), config.get("sentinel", "NA"))
    df = df.withColumns({c: flag(c, yes) for c, yes in config.get("flags", {}).items()})
    df = cast_columns(df, config.get("casts", {}))
    zero = [c for cols in config.get("casts", {}).values() for c in cols]
    return df.na.fill(0, subset=zero) if zero else df


def score_job(spark: SparkSession, config: Mapping) -> DataFrame:
    """Read, cleanse, apply the saved model (indexers included), publish as a table, return the table."""
    data = cleanse(spark.table(config["input_table"]), config)
    scored = load_model(config["model_path"]).transform(data)
    out = scored.select(*config["keep"], F.col("prediction").cast("int").alias("prediction"), probability_of(1).alias("p1"))
    publish_ctas(out, config["output_table"], config.get("format", "parquet"))
    return spark.table(config["output_table"])
