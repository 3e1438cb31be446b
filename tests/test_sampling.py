import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfeat.operators import neighbours
from riskfeat.operators import sampling as K
from riskfeat.operators.neighbours import nearest


def labelled(spark, n=600):
    return spark.range(n).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"), (F.col("id") * 1.0).alias("v"))


@pytest.mark.parametrize("n", [0, 1, 137, 599, 600, 900])
def test_take_exactly(spark, n):
    df = labelled(spark)
    got = [r["id"] for r in K.take_exactly(df, n, ["id"]).collect()]
    assert len(got) == len(set(got)) == min(n, 600)
    assert sorted(got) == sorted(r["id"] for r in K.take_exactly(df.repartition(7), n, ["id"]).collect())


def test_take_exactly_among_copies(spark):
    copies = spark.range(300).select(F.lit(1).alias("id"))
    assert K.take_exactly(copies, 120, ["id"]).count() == 120


def test_resample_sizes(spark):
    df = labelled(spark)
    down = {r["label"]: r["count"] for r in K.downsample(df, "label", ["id"]).groupBy("label").count().collect()}
    up = {r["label"]: r["count"] for r in K.upsample(df, "label", ["id"]).groupBy("label").count().collect()}
    assert down == {0: 60, 1: 60} and up == {0: 540, 1: 540}
    drawn = K.upsample(df, "label", ["id"]).where("label = 1").select("id").distinct().count()
    assert 40 < drawn <= 60


def test_splits_are_disjoint_and_complete(spark):
    df = labelled(spark)
    train, test = K.split_by_id(df, ["id"], 0.2)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == 600 and 80 < len(b) < 160
    part = K.sample(df, 0.5)
    assert K.holdout(df, part, ["id"]).count() == 600 - part.count()


def test_balance_fractions(spark):
    got = {r["label"]: r["count"] for r in K.balance(labelled(spark), "label", {0: 0.1, 1: 3.0}).groupBy("label").count().collect()}
    assert got[0] < 120 and got[1] > 100


def brute(points, k):
    out = {}
    for i, (pid, p) in enumerate(points):
        near = sorted((float(np.sqrt(((p - q) ** 2).sum())), qid) for qid, q in points if qid != pid)[:k]
        out[pid] = near
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    points = [(i, np.round(rng.normal(size=3), 1)) for i in range(180)]
    # A third of all rows are copies of one vector.
    points += [(1000 + i, np.array([0.5, 0.5, 0.5])) for i in range(90)]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in points], "id bigint, features array<double>")
    got = {}
    for r in nearest(df, 4, block_rows=block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    want = brute(points, 4)
    assert set(got) == set(want)
    for i, near in want.items():
        mine = [(d, n) for _, d, n in sorted(got[i])]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in near])
        assert [(round(d, 9), n) for d, n in mine] == [(round(d, 9), n) for d, n in near]


def test_smote_points_lie_between_minority_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), int(i < 12)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, label int")
    made = K.smote(df, ["a", "b"], "label", "id", k=3)
    sizes = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert sizes == {0: 48, 1: 48}
    small = np.array([[a, b] for _, a, b, y in rows if y])
    for r in made.where("synthetic").collect():
        p = np.array([r["a"], r["b"]])
        gaps = [abs(np.linalg.norm(p - u) + np.linalg.norm(p - v) - np.linalg.norm(u - v)) for u in small for v in small]
        assert min(gaps) < 1e-9


def test_edited_neighbours_drop_disagreeing_majority(spark):
    rows = [(1, 0.0, 0), (2, 0.1, 0), (3, 0.2, 0), (4, 0.3, 0), (5, 5.0, 1), (6, 5.1, 1), (7, 5.05, 0), (8, 5.2, 1)]
    df = spark.createDataFrame(rows, "id bigint, a double, label int")
    kept = {r["id"] for r in K.edited_neighbours(df, ["a"], "label", "id", k=3, of_class=0).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, 8}


def test_few_candidates_in_many_dimensions(spark):
    """Codes leave at most a twentieth of all pairs to an exact check, and every true neighbour is among them."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 64)) + rng.integers(0, 4, 1500)[:, None]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, features array<double>").repartition(4)
    vectors, pairs = neighbours.candidates(df, 5, block_rows=400)
    assert vectors.count() == 1500 and set(pairs.columns) == {"vid", "near"}
    got = {}
    for r in pairs.collect():
        got.setdefault(r["vid"], set()).add(r["near"])
    assert max(len(g) for g in got.values()) <= 1500 / 20
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(1))
        d[i] = np.inf
        assert set(np.argsort(d)[:5].tolist()) <= got[i]


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 7)), rng.normal(size=(20, 7)) * 50, np.zeros((5, 7))])
    cells = neighbours.Cells(x[::3], x.min(0), x.max(0))
    codes = cells.encode(x)
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.indices(true.shape).reshape(2, -1)
    for low, high in ([b.reshape(true.shape) for b in cells.bounds(codes[i], codes[j])], cells.rough(codes, codes)):
        assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()


def test_functions_reach_python_workers_elsewhere(tmp_path):
    """The package is sent along: workers that cannot import it from their folder find it."""
    script = tmp_path / "job.py"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {str(tmp_path / "checkpoint")!r}).getOrCreate())
from riskfeat.operators.sampling import smote
rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i < 6)) for i in range(40)], "id bigint, a double, b double, label int")
print("rows", smote(rows, ["a", "b"], "label", "id", k=2).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 68" in done.stdout, done.stderr[-2000:]


def test_blocks_are_screened_by_one_product(monkeypatch):
    # Far from the origin and of very different widths, with equal vectors among them; no pair matrix is kept in double precision.
    rng = np.random.default_rng(5)
    x = rng.normal(1e3, 1.0, (900, 6)) * np.array([1e-3, 1, 1, 1e4, 1, 1])
    x[700:] = x[:200]
    cells = neighbours.Cells(x[::3], x.min(0), x.max(0))
    ids = np.arange(900)
    points = cells.points(cells.encode(x), ids)
    low, high = (b.reshape(900, 900) for b in cells.bounds(points.codes[np.repeat(ids, 900)], points.codes[np.tile(ids, 900)]))
    low[ids, ids] = high[ids, ids] = np.inf
    kth = np.sort(high, axis=1)[:, 4]
    monkeypatch.setattr(neighbours.Cells, "rough", None)
    for reach in (np.full(900, np.inf), kth * 1.5):
        q, t, least, most = cells.near(points, points, 5, reach)
        assert set(zip(q, t)) >= set(zip(*np.nonzero(low <= kth[:, None])))
        assert np.array_equal(neighbours.kth_of_each(q, most, 900, 5), kth) and np.array_equal(least, low[q, t])


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCKS", 3)
    seen = []
    cuts = neighbours._axis_cuts
    monkeypatch.setattr(neighbours, "_axis_cuts", lambda points, leaves: seen.append(leaves) or cuts(points, leaves))
    x = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, 2, 40).collect()}
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag(np.full(300, np.inf))
    assert got == {(i, n + 1): j for i in range(300) for n, j in enumerate(np.argsort(apart[i])[:2])}
    assert seen[0] == 3
