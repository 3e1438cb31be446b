"""The audit of filter orders against a plain replay of every order over every document."""

import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F
from small import odd_rows

from riskfeat.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int"


def failures(rows):
    """(part, failed filters, doc_id) of (doc_id, text, lang) rows, by the filters' plain meaning."""
    out = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
               "D": re.search(r"[#$%&*|]", t) is not None, "E": earlier}
        out.append((lang or "", {f for f, b in bad.items() if b}, doc_id))
    return out


def replay(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs, out, shapley = failures(rows), {}, Counter()
    for part in {p for p, _, _ in docs}:
        mine = [(f, i) for p, f, i in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(x, i) for x, i in left if f in x]
                left = [(x, i) for x, i in left if f not in x]
                failing = [x for x, _ in mine if f in x]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x == {f} for x in failing),
                                          sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}


def test_odd_tables_against_a_replay(spark, odd):
    r = random.Random(2)
    rows = [x[:3] for x in odd_rows()]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i, _, _ in rows if r.random() < 0.7] + [(9, 1, 0), (9, 0, 1), (None, 1, 1), (777, 1, 1)]
    assert audited(odd, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))) == replay(rows, labels)


def test_loud_repeated_and_symbolic_texts(spark):
    r = random.Random(4)
    words = ["HAT", "tea", "Rain", "su#n", "a", "é", "中文"]
    rows = [(r.choice([i, i // 2, None]), " ".join(r.choice(words[:r.randint(1, 7)]) for _ in range(r.choice([0, 1, 199, 200, 230]))), r.choice(["x", "", None])) for i in range(80)]
    rows += [r.choice(rows) for _ in range(40)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 80, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert audited(docs, spark.createDataFrame(labels, LABELS)) == replay(rows, labels)


def test_empty_tables(spark, nothing, odd):
    none = spark.createDataFrame([], LABELS)
    assert audited(nothing, none) == {}
    rows = [x[:3] for x in odd_rows()]
    assert audited(odd, none) == replay(rows, [])


def test_paths():
    for n in range(1, 7):
        paths = filter_audit.path_counts(n)
        assert len(paths) == n * 2 ** (n - 1)
        for k in range(n):
            assert sum(p for _, j, p in paths if j == k) == factorial(n)
        for state, _, p in paths:
            assert p == factorial(state.bit_count()) * factorial(n - 1 - state.bit_count())


def test_any_filters(spark):
    rows = spark.createDataFrame([("p", 1, 0, True, False), ("p", 0, 0, True, True), ("q", 0, 1, False, False)], "part string, good int, toxic int, x boolean, y boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.audit_failures(rows, ["x", "y"]).collect()}
    assert got["p", "xy", 1] == (0, 2, 0, 3) and got["p", "xy", 2] == (0, 0, 1, 1) and got["p", "yx", 2] == (0, 1, 1, 3) and got["q", "yx", 1] == (1, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit_failures(rows, [])
