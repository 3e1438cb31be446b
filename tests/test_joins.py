import random

import pytest
from pyspark.sql import functions as F

from riskfeat.functions.fixed_values import CLEARING_RANGES
from riskfeat.operators import joins as J
from riskfeat.operators import transactions as TR


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def limit(t):
    return 0 if len(t) <= 2 else 1 if len(t) <= 4 else 2


def mutated(rng, t, n):
    for _ in range(n):
        at, how = rng.randrange(len(t) + 1), rng.randrange(3)
        letter = rng.choice("abcdeé")
        t = t[:at] + letter + t[at:] if how == 0 else t[:at] + t[at + 1:] if how == 1 else t[:at] + letter + t[at + 1:]
    return t


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcde") for _ in range(n)) for n in list(range(1, 9)) * 6 + [18, 19, 20, 21, 22, 23, 24, 40, 41, 80]}
    others = {m for w in words for m in (mutated(rng, w, 1), mutated(rng, w, 2), mutated(rng, w, 3), w) if m}
    left = spark.createDataFrame([(w,) for w in sorted(words)], "a string")
    right = spark.createDataFrame([(w,) for w in sorted(others)], "b string")
    got = {(r["l"], r["r"], r["distance"]) for r in J.fuzzy_token_pairs(left, right, "a", "b").collect()}
    want = {(x, y, distance(x, y)) for x in words for y in others if distance(x, y) <= limit(x)}
    assert got == want


def test_fuzzy_pairs_use_no_nested_loop(spark):
    left = spark.createDataFrame([("abcde",)], "a string")
    plan = J.fuzzy_token_pairs(left, left, "a", "a")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_clearing_ranges(spark):
    codes = ["9550", " 9569 ", "95501", "8123-4", "80001", "9465", "6000", "1450", "0", "00", "abc", None, "7000", "9999"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = {r["code"]: r["counterparty"] for r in TR.counterparty(df, "code").collect()}

    def want(code):
        whole = head = None
        if code is not None:
            try:
                whole = float(code.strip())
            except ValueError:
                pass
            try:
                head = float(code[:4])
            except ValueError:
                pass
        for form, lo, hi, name in CLEARING_RANGES:
            v = whole if form == "full" else head
            if v is not None and lo <= v <= hi:
                return name
        return "Other"

    assert got == {c: want(c) for c in codes}
    assert got["9465"] == "GE Money Bank"


def test_range_class_is_closed_and_first_wins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 10.5, None)], "v double")
    got = [r["c"] for r in J.range_class(df, F.col("v"), [(0, 10, "a"), (5, 20, "b")], "c").collect()]
    assert got == [None, "a", "a", "a", "b", None]


def test_lookback_bounds(spark):
    anchor = spark.createDataFrame([(1, "2018-07-01"), (1, "2018-08-31"), (2, "2018-07-01")], "p int, a string").withColumn("a", F.to_date("a"))
    events = spark.createDataFrame(
        [(1, "2017-12-31"), (1, "2018-01-01"), (1, "2018-02-27"), (1, "2018-02-28"), (1, "2018-06-30"), (1, "2018-07-01"), (1, "2018-08-31")],
        "p int, e string",
    ).withColumn("e", F.to_date("e"))
    got = {(r["a"].isoformat(), r["e"].isoformat()) for r in J.lookback_join(anchor, events, "p", "a", "e", 6).collect()}
    assert got == {
        ("2018-07-01", "2018-01-01"), ("2018-07-01", "2018-02-27"), ("2018-07-01", "2018-02-28"), ("2018-07-01", "2018-06-30"),
        ("2018-08-31", "2018-02-28"), ("2018-08-31", "2018-06-30"), ("2018-08-31", "2018-07-01"),
    }


def test_lookback_features_flag_empty_anchor(spark):
    anchor = spark.createDataFrame([(1, "2018-07-01"), (2, "2018-07-01")], "p int, a string").withColumn("a", F.to_date("a"))
    events = spark.createDataFrame([(1, "2018-03-05", 10.0), (1, "2018-03-09", 20.0), (1, "2018-05-01", 60.0)], "p int, e string, x double").withColumn("e", F.to_date("e"))
    got = {r["p"]: r for r in TR.lookback_features(anchor, events, "p", "a", "e", "x", 6).collect()}
    assert (got[1]["n"], got[1]["sum"], got[1]["avg"], got[1]["flag"]) == (3, 90.0, 30.0, 1)
    assert got[1]["std"] == pytest.approx(26.457513110645905)
    assert (got[2]["n"], got[2]["sum"], got[2]["flag"]) == (0, None, 0)


def test_trimmed_join_and_lookup(spark):
    a = spark.createDataFrame([(" x ", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", "X"), ("y  ", "Y")], "code string, name string")
    assert sorted((r["v"], r["name"]) for r in J.join_trimmed(a, b, "k", "code").collect()) == [(1, "X"), (2, "Y")]
    plan = J.lookup_join(a, b.withColumnRenamed("code", "k"), ["k"], max_rows=1)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


def test_range_table_of_many_overlapping_ranges(spark):
    import duckdb
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    n = 100_000
    lo = rng.integers(0, 1_000_000, n).astype(float)
    wide = np.where(rng.random(n) < 0.001, 500_000.0, rng.integers(0, 300, n))
    ranges = pd.DataFrame({"lo": lo, "hi": lo + wide, "priority": rng.integers(0, 50_000, n), "name": [f"r{i:06d}" for i in range(n)]})
    points = pd.DataFrame({"id": np.arange(5_000), "v": np.where(np.arange(5_000) % 3 == 0, 77_777.0, rng.integers(-1000, 1_600_000, 5_000) / 2)})
    got = J.range_table_class(spark.createDataFrame(points), F.col("v"), spark.createDataFrame(ranges), "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    con = duckdb.connect()
    con.register("r", ranges)
    con.register("p", points)
    want = con.execute("SELECT id, min({'p': priority, 'n': name}).n FROM p LEFT JOIN r ON v >= lo AND v <= hi GROUP BY id").fetchall()
    assert sorted((r["id"], r["name"]) for r in got.select("id", "name").collect()) == sorted(want)


def test_range_table_of_odd_rows(spark):
    nan = float("nan")
    ranges = spark.createDataFrame(
        [(0.0, 10.0, 2, "b"), (0.0, 10.0, 2, "a"), (5.0, 5.0, 1, "point"), (9.0, 20.0, 3, "c"), (None, 30.0, 0, "null"), (0.0, nan, 0, "nan"), (8.0, 1.0, 0, "turned"), (float("inf"), float("inf"), 9, "last")],
        "lo double, hi double, priority int, name string",
    )
    values = [-1.0, -0.0, 4.9, 5.0, 5.1, 10.0, 10.5, 20.0, 20.1, float("inf"), nan, None, 5.0]
    df = spark.createDataFrame([(v, "x", i, 7) for i, v in enumerate(values)], "v double, piece string, i int, at int")
    got = J.range_table_class(df, F.col("v"), ranges, "piece").orderBy("i").collect()
    assert [r["piece"] for r in got] == [None, "a", "a", "point", "a", "a", "c", "c", None, "last", None, None, "point"]
    assert got[0].asDict().keys() == {"v", "i", "at", "piece"}
    assert [r["c"] for r in J.range_table_class(df, F.col("v"), ranges.limit(0), "c").collect()] == [None] * len(values)
    assert J.range_table_class(df.limit(0), F.col("v"), ranges, "c").count() == 0
