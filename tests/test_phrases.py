import random
import re

from riskfeat.functions.text import computed_once
from riskfeat.operators import phrases as P

from pyspark.sql import functions as F


def places(texts, listed):
    """All places of the listed phrases, the direct way."""
    listed = {" ".join(p.split()) for p in listed if p and p.split()}
    longest = max((len(p.split()) for p in listed), default=0)
    out = set()
    for key, text in texts:
        words = (text or "").split()
        for i in range(len(words)):
            for n in range(1, min(longest, len(words) - i) + 1):
                if (run := " ".join(words[i:i + n])) in listed:
                    out.add((key, i, run, n))
    return out


def test_hundred_thousand_phrases(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    # A third of all words is one word.
    texts = [(i, " ".join(rng.choice(vocabulary) if rng.random() < 2 / 3 else "the" for _ in range(rng.choice([0, 1, 5, 40, 400])))) for i in range(300)]
    listed = []
    while len(listed) < 100_000:
        words = rng.choice(texts)[1].split()
        if words and rng.random() < 0.5:
            i = rng.randrange(len(words))
            listed.append(" ".join(words[i:i + rng.randint(2, 12)]))
        else:
            listed.append(" ".join(rng.choices(["the", *vocabulary], k=rng.randint(2, 12))))
    listed += vocabulary[:20]
    docs = spark.createDataFrame(texts, "id int, t string")
    got = P.phrase_places(docs, "t", spark.createDataFrame([(p,) for p in listed], "phrase string"), ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in got.collect()} == places(texts, listed)
    words = computed_once(docs, ["id"], _w=F.split("t", " ")).withColumn("_text", F.lit(0))
    assert P.phrase_heads(words, ["id"]).count() <= 2 * sum(max(1, len(t.split())) for _, t in texts)


def test_first_phrase_equals_the_pattern(spark):
    listed = ["a", "a b", "a b c", "c a", "b b b", "d"]
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choices("abcef", k=rng.randint(0, 9)))) for i in range(200)]
    pattern = re.compile(r"(?:^|\s)(" + "|".join(sorted(listed, key=len, reverse=True)) + r")(?=\s|$)")
    want = {i: m.group(1) for i, t in texts if (m := pattern.search(t))}
    docs, table = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(p,) for p in listed], "phrase string")
    got = P.first_phrase(docs, "t", table, ["id"]).collect()
    assert {r["id"]: r["match"] for r in got} == want
    assert all(r["n_words"] == len(r["match"].split()) for r in got)


def test_odd_rows(spark):
    schema = "id int, t string"
    texts = [(1, None), (2, ""), (3, " \n "), (None, "x  y"), (4, "x\ty z"), (4, "z x"), (4, "z x"), (5, "y x")]
    listed = [None, "", "  ", " x   y ", "x y", "z", "x y z q"]
    table = spark.createDataFrame([(p,) for p in listed], "phrase string")
    got = P.phrase_places(spark.createDataFrame(texts, schema), "t", table, ["id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 0, "x y", 2), (4, 0, "x y", 2), (4, 2, "z", 1), (4, 0, "z", 1)], key=str)
    assert P.phrase_places(spark.createDataFrame(texts, schema), "t", table.limit(0), ["id"]).count() == 0
    assert P.first_phrase(spark.createDataFrame([], schema), "t", table, ["id"]).count() == 0
