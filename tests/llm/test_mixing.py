"""Targets by filling up, copies by rate, nothing lost of a row."""

import duckdb
import pytest
from small import table

from riskfeat.llm import mixing
from riskfeat.llm.plans import MIX_SQL


def filled(sizes: dict, weights=(5, 2, 1), most=3):
    """Share everything by weight; fix full sources at their cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "Z": 5, None: 7}, {"x": 0, "y": 0}, {"only": 50}, {"a": 5, "b": 0, "é": 9, "z": 2, "zz": 100},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_odd_rows_match_sql(odd):
    df = mixing.mix(odd)
    con = duckdb.connect()
    documents = odd.select("doc_id", "text", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    cur = con.execute(MIX_SQL)
    assert table(df.collect(), df.columns) == table(cur.fetchall(), [c[0] for c in cur.description])


def test_emit_repeats_whole_rows(odd):
    copies = {}
    for r in mixing.mix(odd).collect():
        copies.setdefault(r["doc_id"], []).append(r["copies"])
    out = mixing.emit(odd)
    assert out.schema == odd.schema
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {k: sum(v) for k, v in copies.items() if sum(v)}
    assert max(max(v) for v in copies.values()) <= mixing.MOST


def test_taken_words_come_near_the_target(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 40 as int)) AS text", "concat('s', id % 3) AS source")
    rows = mixing.mix(df).groupBy("source_size", "target").sum("taken").collect()
    assert len(rows) == 3
    for r in rows:
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.05)


def test_no_rows_and_no_python(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.emit(nothing).count() == 0
    plan = mixing.emit(nothing)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
