"""Compression gains, thresholds and whole-table scores."""

import random

import numpy as np
import pytest
from small import VOCABULARY

from riskfeat.llm import toxicity
from riskfeat.llm.language import held_out

BAD = ["grimblort", "snarvex", "quobbling"]
LABELS = "doc_id bigint, toxic int, quality int"


def text(r, toxic):
    words = [r.choice(VOCABULARY) for _ in range(r.randint(20, 90))]
    if toxic:
        for _ in range(max(2, len(words) // 10)):
            words[r.randrange(len(words))] = r.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    rows = [(i, text(r, i % 4 == 0), "en", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").repartition(4)
    return docs, spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(500)], LABELS), {i: t for i, t, _, _ in rows}


def test_windows_cover_whole_texts():
    r = random.Random(3)
    for n in (0, 1, 47, 48, 49, 5000):
        for blank in (0.0, 0.01, 0.2):
            t = bytes(32 if r.random() < blank else r.randrange(97, 123) for _ in range(n))
            pieces = toxicity.windows(t)
            assert b"".join(pieces) == t and all(len(p) <= 2 * toxicity.WINDOW for p in pieces)
            assert all(len(p) >= toxicity.WINDOW for p in pieces[:-1])


def test_only_what_toxic_text_repeats_gains():
    r = random.Random(1)
    ordinary = [w for _ in range(150) for w in toxicity.windows(text(r, False).encode())]
    toxic = [w for _ in range(150) for w in toxicity.windows(text(r, True).encode())]
    d = toxicity.train(ordinary, toxic)
    fresh = [w for _ in range(80) for w in toxicity.windows(text(r, True).encode())]
    gains = d.gains(fresh)
    bad = np.array([any(b.encode() in w for b in BAD) for w in fresh])
    assert gains[bad].mean() > 3 and abs(gains[~bad].mean()) < 0.5
    assert np.array_equal(gains, [len(toxicity.compressor(d.ordinary).compress(w)) - len(toxicity.compressor(d.toxic + d.ordinary).compress(w)) for w in fresh])
    whole = text(r, True).encode()
    assert d.histogram(whole).tolist() == [sum(g == b or (b == -8 and g < b) or (b == 12 and g > b) for g in d.gains(toxicity.windows(whole))) for b in range(-8, 13)]


def test_held_out_documents(labelled):
    docs, labels, _ = labelled
    rows = toxicity.classify(docs, labels, held_out(1, 3)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 500 and len(held) > 100
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_scores_equal_a_plain_loop(labelled):
    """Every document by itself: windows, two compressed lengths each, ratios summed in a loop, logistic."""
    docs, labels, texts = labelled
    held = held_out(1, 3)
    m = toxicity.fit(docs, labels, held)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, held).collect()}
    plain, both = toxicity.compressor(m.dictionaries.ordinary), toxicity.compressor(m.dictionaries.toxic + m.dictionaries.ordinary)
    for i, t in texts.items():
        evidence, gained, n = [], 0, 0
        for w in toxicity.windows(t.encode()):
            g = min(12, max(-8, len(plain.compress(w)) - len(both.compress(w))))
            evidence.append(m.ratios[g + 8])
            gained += g >= 1
            n += 1
        x = np.array([sum(evidence) / n**0.5, sum(evidence) / n, max(evidence), np.log(n), gained / n, np.log1p(gained)])
        want = 1 / (1 + np.exp(-((x - m.mean) / m.scale @ m.weights[:-1] + m.weights[-1])))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_odd_rows_and_labels(spark, labelled, odd, nothing):
    docs, labels, _ = labelled
    held = held_out(1, 3)
    extra = spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (99999, 1, 1)], LABELS)
    rows = toxicity.classify(docs.unionByName(odd.select("doc_id", "text", "lang"), allowMissingColumns=True), labels.unionByName(extra), held).collect()
    assert len(rows) == 500 + odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in toxicity.classify(odd, labels, held).join(odd.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.classify(nothing, labels, held).count() == 0


def test_predictions_depend_on_the_text_only(spark, labelled):
    docs, labels, texts = labelled
    held = held_out(1, 3)
    shadows = spark.createDataFrame([(i + 100_000, t, "xx", 0) for i, t in texts.items()], docs.schema)
    score = {r["doc_id"]: r["score"] for r in toxicity.classify(docs.unionByName(shadows), labels, held).collect()}
    assert all(score[i] == score[i + 100_000] for i in texts)


def test_labels_of_one_kind_and_few(spark, odd, labelled):
    _, labels, _ = labelled
    held = held_out(1, 3)
    for some, score in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.5)):
        assert {r["score"] for r in toxicity.classify(odd, some, held).collect()} == {score}
    few = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (2, 0, 0)], LABELS)
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify(odd, few, held).collect())
