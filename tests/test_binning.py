import math

import numpy as np
import pandas as pd
import pytest

from riskfeat.operators import binning as B


def make(spark, cols, label):
    n = len(label)
    rows = [tuple(None if cols[c][i] is None or (isinstance(cols[c][i], float) and math.isnan(cols[c][i])) else float(cols[c][i]) for c in cols) + (int(label[i]),) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 800
    x = rng.normal(size=n)
    return {
        "x": x,
        "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.exponential(size=n)),
        "zeros": np.where(rng.random(n) < 0.45, 0.0, rng.integers(1, 30, n)).astype(float),
        "constant": np.full(n, 2.0),
        "empty": np.full(n, np.nan),
    }, (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)


def pandas_bins(v):
    s = pd.Series(v, dtype=float)
    for k in range(10, 0, -1):
        try:
            return pd.qcut(s, k, labels=False).fillna(-1).astype(int)
        except ValueError:
            continue
    return pd.Series(-1, index=s.index)


def test_quantile_woe_equals_pandas(spark, data):
    cols, label = data
    got = {(r["feature"], r["bin"]): r for r in B.woe_table(B.quantile_bins(make(spark, cols, label), list(cols), ["label"]), "label").collect()}
    want = {}
    for c, v in cols.items():
        d = pd.DataFrame({"bin": pandas_bins(v), "v": pd.Series(v).fillna(-1), "y": label})
        for b, g in d.groupby("bin"):
            want[(c, b)] = (g.v.min(), g.v.max(), g.y.sum(), len(g))
    assert set(got) == set(want)
    for key, (lo, hi, events, total) in want.items():
        r = got[key]
        assert (r["events"], r["total"]) == (events, total)
        assert (r["bin_min"], r["bin_max"]) == pytest.approx((lo, hi))
        e, ne = events / label.sum(), (total - events) / (len(label) - label.sum())
        if e and ne:
            assert r["woe"] == pytest.approx(math.log(e / ne))
            assert r["iv"] == pytest.approx((e - ne) * math.log(e / ne))


def test_one_class_bin_is_infinite(spark):
    df = make(spark, {"f": [1.0] * 4 + [2.0] * 4}, [0, 0, 0, 0, 0, 1, 1, 1])
    rows = {r["bin"]: r for r in B.woe_table(B.quantile_bins(df, ["f"], ["label"], cells=2), "label").collect()}
    assert rows[0]["woe"] == -math.inf and rows[0]["iv"] == math.inf
    assert B.select_by_iv(B.total_iv(B.woe_table(B.quantile_bins(df, ["f"], ["label"], cells=2), "label"))).count() == 1


def greedy_tree(x, y, leaves, share):
    """Best-first entropy tree over one feature, the direct way."""
    need = math.ceil(share * len(x))

    def nh(ys):
        n, b = len(ys), ys.sum()
        return -sum(k * math.log(k / n) for k in (b, n - b) if k)

    def best(at):
        xs, ys = x[at], y[at]
        found = None
        values = np.unique(xs)
        for lo, hi in zip(values, values[1:]):
            left = xs <= lo
            if left.sum() < need or (~left).sum() < need:
                continue
            gain = nh(ys) - nh(ys[left]) - nh(ys[~left])
            if found is None or round(gain, 9) > round(found[0], 9):
                found = (gain, lo + (hi - lo) / 2)
        return found

    open_leaves, cuts = [(best(np.arange(len(x))), np.arange(len(x)))], []
    while len(cuts) < leaves - 1:
        ready = [o for o in open_leaves if o[0] and o[0][0] > 0]
        if not ready:
            break
        top = min(ready, key=lambda o: (-round(o[0][0], 9), o[0][1]))
        open_leaves = [o for o in open_leaves if o is not top]
        cut, at = top[0][1], top[1]
        cuts.append(cut)
        for side in (at[x[at] < cut], at[x[at] >= cut]):
            open_leaves.append((best(side), side))
    return sorted({x.min(), *cuts, x.max() + 0.1})


def test_tree_edges_equal_direct_tree(spark, data):
    cols, label = data
    got = {r["feature"]: r["edges"] for r in B.tree_boundaries(make(spark, cols, label), list(cols), "label").collect()}
    for c in ("x", "gaps", "zeros", "constant"):
        v = np.array(cols[c], dtype=float)
        ok = ~np.isnan(v)
        assert got[c] == pytest.approx(greedy_tree(v[ok], label[ok], 6, 0.05)), c
    assert "empty" not in got


def test_tree_woe_bins_cover_rows(spark, data):
    cols, label = data
    df = make(spark, cols, label)
    dropped = {r["feature"]: r["n"] for r in B.tree_woe(df, ["gaps"], "label").groupBy("feature").agg({"total": "sum"}).withColumnRenamed("sum(total)", "n").collect()}
    kept = {r["feature"]: r["n"] for r in B.tree_woe(df, ["gaps"], "label", missing="bin").groupBy("feature").agg({"total": "sum"}).withColumnRenamed("sum(total)", "n").collect()}
    assert dropped["gaps"] == int((~np.isnan(cols["gaps"])).sum()) and kept["gaps"] == len(label)


def test_sweep_covers_segments_and_fills(spark, data):
    cols, label = data
    df = make(spark, {"x": cols["x"], "gaps": cols["gaps"], "seg": (np.arange(len(label)) % 2).astype(float)}, label)
    got = B.iv_sweep(df, ["x", "gaps"], "label", "seg").collect()
    assert len(got) == 2 * 3 * 2 and all(r["iv"] >= 0 for r in got)
    same = {(r["segment"], r["fill"]): r["iv"] for r in got if r["feature"] == "x"}
    assert same[(0.0, "none")] == pytest.approx(same[(0.0, "zero")])


def test_tree_edges_of_two_hundred_thousand_keys(spark):
    n = 200_000
    rows = spark.range(4 * n).selectExpr("id % 200000 AS k", "CAST(id div 200000 AS DOUBLE) AS value", "CAST(id div 400000 = 1 AND id % 4 <> 3 AS INT) AS label")
    got = B.tree_edge_rows(rows, ["k"], "label").groupBy("edges").count().collect()
    assert {tuple(r["edges"]): r["count"] for r in got} == {(0.0, 1.5, 3.1): n * 3 // 4, (0.0, 3.1): n // 4}


def test_tree_edges_of_odd_tables(spark):
    schema = "k string, value double, label int"
    rows = [(None, 1.0, 0), (None, 2.0, 1), (None, float("nan"), 1), ("a", None, 1), ("b", 1.0, 0), ("b", 1.0, 1), ("c", 1.0, 0), ("c", 1.0, 0), ("c", 3.0, 1), ("c", 3.0, None)]
    got = {r["k"]: r["edges"] for r in B.tree_edge_rows(spark.createDataFrame(rows, schema), ["k"], "label").collect()}
    assert got == {None: [1.0, 1.5, 2.1], "b": [1.0, 1.1], "c": [1.0, 2.0, 3.1]}
    assert B.tree_edge_rows(spark.createDataFrame([], schema), ["k"], "label").count() == 0


def test_sweep_and_tree_table_read_the_rows_once(spark, monkeypatch):
    """Edges, medians and bins come from stored counts of values: what is joined with the edges has no more rows than those."""
    rng = np.random.default_rng(4)
    n = 2000
    x = [None if i % 9 == 0 else float("nan") if i % 31 == 0 else float(v) for i, v in enumerate(rng.integers(0, 12, n))]
    rows = [(f"s{i % 2}", v, float(i % 3), int(rng.random() < 0.1 + 0.06 * (v if v and v == v else 0))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "part string, x double, z double, y int")
    seen, table = [], B.woe_table
    monkeypatch.setattr(B, "woe_table", lambda binned, *a, **k: (seen.append(binned.count()), table(binned, *a, **k))[1])
    p = pd.DataFrame(rows, columns=["part", "x", "z", "y"])
    present = p.x[p.x.notna() & (p.x != 0)]
    filled = {"none": p.x, "zero": p.x.fillna(0), "median": p.x.replace(0, np.nan).fillna(present.median())}
    for method in ("quantile", "tree"):
        got = {(r["segment"], r["fill"], r["feature"]): r["iv"] for r in B.iv_sweep(df, ["x", "z"], "y", "part", method=method).collect()}
        assert len(got) == 12 and seen[-1] <= 2 * 2 * 3 * (13 + 3)
        for part in ("s0", "s1"):
            for fill, values in filled.items():
                mine = p.part == part
                one = make(spark, {"x": list(values[mine])}, list(p.y[mine]))
                if method == "tree":
                    want = B.tree_woe(one, ["x"], "label", missing="bin").agg({"iv": "sum"}).first()[0]
                else:
                    bins = pandas_bins(values[mine].to_numpy(float))
                    e = p.y[mine].groupby(bins.to_numpy()).agg(["sum", "count"])
                    good, bad = e["sum"] / e["sum"].sum(), (e["count"] - e["sum"]) / (e["count"] - e["sum"]).sum()
                    want = ((good - bad) * np.log(good / bad)).sum()
                assert got[part, fill, "x"] == pytest.approx(want)
    B.tree_woe(df, ["x"], "y", missing="bin").collect()
    assert seen[-1] <= 2 * 14
