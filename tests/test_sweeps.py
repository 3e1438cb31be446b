"""Many fits in one pass, against single fits from scratch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskfeat.operators import models as M
from riskfeat.operators import prepare as P
from riskfeat.operators import sweeps as S

COLS = ["a", "b", "c", "d", "flat"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)) * [1.0, 100.0, 0.01, 1.0] + [0.0, 5_000.0, 0.0, 3.0]
    x[:, 3] += x[:, 0]
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] + 0.01 * (x[:, 1] - 5_000) - 1.0)))
    y = (rng.random(600) < p).astype(float)
    rows = [(i, *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, flat double, label double").repartition(5).cache()


def fold_of(folds):
    return F.pmod(F.xxhash64("id"), F.lit(folds))


def single_fit(df, candidate, standardize=True):
    weights = candidate.weights
    if weights == "balanced":
        sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
        weights = [sum(sizes.values()) / (2 * sizes[c]) for c in (0.0, 1.0)]
    weighted = P.assemble(df.withColumn("w", F.when(F.col("label") == 1, float(weights[1])).otherwise(float(weights[0]))), COLS)
    est = LogisticRegression(regParam=candidate.reg, elasticNetParam=candidate.mixing, weightCol="w", tol=1e-13, maxIter=2000, standardization=standardize)
    m = est.fit(weighted)
    return m, [*m.coefficients.toArray(), m.intercept]


def test_coefficients_equal_single_fits(spark, data):
    candidates = S.grid([0.001, 0.05], [0.0, 0.5], [(1.0, 1.0), (1.0, 3.0), "balanced"])
    found = S.logistic_sweep(data, COLS, "label", ["id"], candidates, folds=3)
    got = {(r["candidate"], r["fold"], r["feature"]): r["coefficient"] for r in found.coefficients.collect()}
    assert len(got) == len(candidates) * 4 * 6
    areas = {(r["candidate"], r["fold"]): r["area"] for r in found.areas.collect()}
    for c, k in [(0, -1), (1, 0), (3, 1), (5, 2), (6, -1), (8, 0), (11, 2)]:
        model, want = single_fit(data.where(fold_of(3) != k), candidates[c])
        mine = np.array([got[c, k, f] for f in [*COLS, "intercept"]])
        spread = np.array([1.0, 100.0, 0.01, 1.4, 1.0, 1.0])
        assert np.abs(mine[:5] - want[:5]) * spread[:5] == pytest.approx(0, abs=2e-6)
        assert mine[5] == pytest.approx(want[5], abs=2e-4)
        if k >= 0:
            scored = model.transform(P.assemble(data.where(fold_of(3) == k), COLS)).withColumn("p", M.probability_of(1))
            assert areas[c, k] == pytest.approx(M.auc(scored, "label", "p").first()["roc"], abs=1e-3)
    # The grid takes the passes of its slowest model.
    assert found.passes <= 20


def test_areas_equal_brute_force(spark, data):
    small = data.where("id < 80").select("id", F.round("a", 0).alias("a"), "label")
    found = S.logistic_sweep(small, ["a"], "label", ["id"], [S.Candidate(0.01)], folds=2)
    coef = {r["fold"]: r["coefficient"] for r in found.coefficients.where("feature = 'a'").collect()}
    for r in found.areas.collect():
        rows = small.where(fold_of(2) == r["fold"]).collect()
        pos = [coef[r["fold"]] * x["a"] for x in rows if x["label"] == 1]
        neg = [coef[r["fold"]] * x["a"] for x in rows if x["label"] == 0]
        wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
        assert r["area"] == pytest.approx(wins / len(pos) / len(neg))


def test_areas_by_ranges_of_scores(spark, monkeypatch):
    # Ranges, ties over their ends, flushes of some rows, a score for all rows, NaN as the largest, a fold of one class.
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(-30, 30)), float(rng.normal()), float(rng.integers(0, 2)), int(rng.integers(0, 2))) for _ in range(900)]
    rows += [(0.0, float("inf"), float(k % 2), 0) for k in range(5)] + [(1.0, 1.0, 1.0, 2)] * 3
    table = spark.createDataFrame(rows, "x0 double, x1 double, label double, fold int").repartition(3)
    models = [(0, 0, [1.0, 0.0], 0.5), (1, 0, [0.3, 1.0], 0.0), (0, 1, [0.0, 0.0], 1.0), (1, 1, [-1.0, 1e-3], 0.0), (0, 2, [1.0, 0.0], 0.0)]
    want = {}
    for c, k, slopes, intercept in models:
        with np.errstate(all="ignore"):
            scored = [(intercept + slopes[0] * x0 + slopes[1] * x1, y) for x0, x1, y, f in rows if f == k]
        rank = [(np.inf if np.isnan(m) else m, np.isnan(m), y) for m, y in scored]
        pos, neg = [r[:2] for r in rank if r[2] == 1], [r[:2] for r in rank if r[2] == 0]
        wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
        want[c, k] = wins / len(pos) / len(neg) if pos and neg else None
    for points, scores in ((1 << 20, 1 << 17), (10, 64)):
        monkeypatch.setattr(S, "POINTS", points)
        monkeypatch.setattr(S, "SCORES", scores)
        got = {(r["candidate"], r["fold"]): r["area"] for r in S._areas(table, ["x0", "x1"], models, float(len(rows))).collect()}
        assert got.pop((0, 2)) is None and want[0, 2] is None
        assert got == pytest.approx({at: a for at, a in want.items() if a is not None}, abs=1e-12)


def test_odd_rows_leave_the_fit_alone(spark, data):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1.0, 1.0, 1.0, 1.0, 1.0), (2, nan, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 1.0, inf, 1.0, 1.0, 1.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0, None), (4, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)]
    both = data.unionByName(spark.createDataFrame(odd, data.schema))
    one, two = (
        sorted((r["fold"], r["feature"], r["coefficient"]) for r in S.logistic_sweep(d, COLS, "label", ["id"], [S.Candidate(0.01)], folds=2).coefficients.collect())
        for d in (data, both)
    )
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in two], rel=1e-9, abs=1e-9)


def test_one_class_and_no_rows(spark, data):
    for df in (data.where("label = 1"), data.limit(0)):
        found = S.logistic_sweep(df, COLS, "label", ["id"], [S.Candidate()], folds=2)
        assert {r["coefficient"] for r in found.coefficients.collect()} == {None}
        assert [r["area"] for r in found.areas.collect()] == [None, None]
        assert S.eliminate(df, COLS, "label", 3)[0] == ["flat", "d"]


def test_clashing_names_and_repeated_ids(spark, data):
    clash = data.select(F.lit(1).alias("id"), F.col("a").alias("fold"), F.col("b").alias("x0"), F.col("label").alias("fit"))
    found = S.logistic_sweep(clash, ["fold", "x0"], "fit", ["id"], [S.Candidate(0.01)], folds=2)
    whole = {r["feature"]: r["coefficient"] for r in found.coefficients.where("fold = -1").collect()}
    assert whole["fold"] > 0.5 and whole["x0"] > 0.005
    # Equal ids are one fold: its model has no rows, and the other fold has none to score.
    assert {r["area"] for r in found.areas.collect()} == {None}


def from_scratch(x, y, cols, n, reg=1e-3):
    """Elimination with a full Newton fit for every subset."""
    left, out = list(range(len(cols))), []
    while len(left) > n:
        z = np.column_stack([x[:, left], np.ones(len(x))])
        ridge = np.diag([reg] * len(left) + [0.0])
        b = np.zeros(len(left) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ b))
            b = b - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(x) + ridge, z.T @ (p - y) / len(x) + ridge @ b)
        out.append(cols[left.pop(int(np.argmin(np.abs(b[:-1]))))])
    return out


@pytest.mark.parametrize("ahead", [1, 4, 16])
def test_elimination_equals_fits_from_scratch(spark, ahead):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 24)) @ (np.eye(24) + 0.3 * rng.normal(size=(24, 24)))
    y = (rng.random(800) < 1 / (1 + np.exp(-x @ rng.normal(size=24) * 0.3))).astype(float)
    cols = [f"f{i}" for i in range(24)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(3)
    got, passes = S.eliminate(df, cols, "y", 4, ahead=ahead)
    assert got == from_scratch(x, y, cols, 4)
    if ahead == 16:
        # Twenty fits from scratch take some hundred passes.
        assert passes <= 20


def test_elimination_with_equal_columns(spark, data):
    twice = data.withColumn("a2", F.col("a"))
    got, _ = S.eliminate(twice, ["a", "a2", "flat"], "label", 1)
    assert got[0] == "flat" and got[1] == "a"


@pytest.mark.parametrize("columns", [3, 20])
def test_sums_of_a_pass(columns):
    # Margins up to hundreds: neither side overflows, and the small probability is not one less the large one.
    rng = np.random.default_rng(4)
    names = [f"x{i}" for i in range(columns)]
    x = rng.normal(0, 1, (50, columns)) * 40
    b = pd.DataFrame(x, columns=names).assign(label=rng.integers(0, 2, 50).astype(float), fold=rng.integers(0, 2, 50))
    flat = np.zeros(columns + 1)
    fits = [S._Fit(k, (1.0, 2.0), flat, flat, flat > 0, rng.normal(0, 1, columns + 1)) for k in (-1, 0, 1)]
    exponentials = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "logaddexp", lambda *a: exponentials.append(a))
        got = next(S._sums(names, np.zeros(columns), np.ones(columns), fits)(iter([b])))
    assert not exponentials
    z = np.column_stack([x, np.ones(50)])
    y, fold = b["label"].to_numpy(), b["fold"].to_numpy()
    for f, row in zip(fits, got["sums"]):
        w = np.where(y == 1, 2.0, 1.0) * (fold != f.left_out)
        m = z @ f.trial
        p, q = np.exp(-np.logaddexp(0, -m)), np.exp(-np.logaddexp(0, m))
        assert np.isclose(row[0], (w * (np.logaddexp(0, m) - y * m)).sum())
        assert np.allclose(row[1 : columns + 2], z.T @ (w * (p - y)))
        assert np.allclose(row[columns + 2 :], (z.T @ ((w * p * q)[:, None] * z))[np.triu_indices(columns + 1)], rtol=1e-9)
