"""Language and quality models on small tables, and the gradients they are trained with."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small import VOCABULARY

from riskfeat.llm import language, quality


@pytest.fixture(scope="module")
def two_languages(spark):
    text = F.when(F.col("id") % 2 == 0, F.repeat(F.lit("the cat sat there with that hat "), 3)).otherwise(F.repeat(F.lit("der über schöne nicht und auch wir "), 3))
    return spark.range(300).select(F.col("id").alias("doc_id"), F.concat(text, F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))


def test_languages(two_languages, odd, nothing):
    rows = language.identify(two_languages, language.held_out()).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 == 0 else "de") and 0.8 < r["score"] <= 1 for r in rows)
    none = two_languages.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    got = language.identify(none.select("*", F.lit(1).alias("held_out2")), language.held_out()).collect()
    assert len(got) == 300 + odd.count()
    silent = [r for r in got if r["lang_pred"] == language.UNDETERMINED]
    assert len(silent) == 5 and all(r["score"] == 0 and r["rejected"] for r in silent)
    assert {r["lang_pred"] for r in got} == {"en", "de", "und"}
    assert language.identify(nothing, language.held_out()).count() == 0


def test_far_texts_are_rejected(spark, two_languages):
    far = spark.createDataFrame([(1000, "zzqx jjkw vvbz qqpx " * 20, None)], "doc_id bigint, text string, lang string")
    r = language.identify(two_languages.unionByName(far), language.held_out()).where("doc_id = 1000").first()
    assert r["rejected"] and r["lang_pred"] in ("en", "de")


def test_nothing_to_learn_from(odd):
    rows = language.identify(odd.withColumn("lang", F.lit(None).cast("string")), language.held_out()).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def test_predictions_depend_on_the_text_only(two_languages):
    """Held-out shadows with other ids, languages and sources get their originals' answers."""
    held = language.held_out()
    shadows = two_languages.select((F.col("doc_id") + 9000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("other").alias("source")).where(held)
    both = two_languages.withColumn("source", F.lit("one")).unionByName(shadows)
    rows = language.identify(both, held).join(both.select("doc_id", "text"), "doc_id").collect()
    answers = {}
    for r in rows:
        answers.setdefault(r["text"], set()).add((r["lang_pred"], r["score"], r["rejected"]))
    assert len(rows) > 350 and len(answers) == 300 and all(len(a) == 1 for a in answers.values())


def test_clusters():
    r = np.random.default_rng(0)
    base = np.eye(3, 20)
    x = np.abs(base[r.integers(0, 3, 90)] + 0.01 * r.standard_normal((90, 20)))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    centres, which = language.spherical_kmeans(x, 3)
    assert sorted(np.argmax(centres, axis=1).tolist()) == [0, 1, 2]
    assert (np.argmax(x, axis=1) == np.argmax(centres, axis=1)[which]).all()


def test_gradients():
    r = np.random.default_rng(3)
    x, first, y = r.standard_normal((11, 6)).astype(np.float32), np.array([0, 1, 4, 9, 11]), np.array([1, 0, 1, 0], np.float32)
    model = quality.Model.fresh(x, hidden=5, gate=4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    grads = model.gradients(x, first, y)

    def loss():
        p = model.forward(x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:6]:
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-4), (k, at)


def test_passages_cover_whole_texts():
    texts = pa.array(["", "one two", " ".join(VOCABULARY * 10), "A!! b"])
    x, first = quality.passages(texts)
    n = [0, 2, len(VOCABULARY) * 10, 2]
    assert np.diff(first).tolist() == [max(1, -(-k // quality.PASSAGE)) for k in n]
    assert np.allclose(np.add.reduceat(x[:, -2], first[:-1]) * quality.PASSAGE, n)
    one = quality.passages(texts.slice(2, 1))[0]
    assert np.allclose(one, x[first[2]:first[3]])


@pytest.fixture(scope="module")
def labelled(spark):
    good = F.col("id") % 3 != 0
    text = F.when(good, F.concat(F.lit("plain words in a row "), F.repeat(F.lit("and more of them "), (F.col("id") % 40).cast("int")))).otherwise(
        F.repeat(F.lit("LOUD!! $$$ "), (1 + F.col("id") % 40).cast("int")))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(0.1).alias("score"), F.lit(1).alias("label"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), F.when(good, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    return docs, labels


def test_quality(spark, labelled, odd, nothing):
    docs, labels = labelled
    extra = spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(docs, labels.unionByName(extra), language.held_out(0, 5)).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in rows]) > 0.99
    got = quality.classify(odd, labels, language.held_out(0, 5)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accepted(odd, labels, language.held_out(0, 5))
    assert kept.schema == odd.schema
    mixed = quality.accepted(docs, labels, language.held_out(0, 5))
    assert mixed.columns == docs.columns and mixed.where("doc_id % 3 = 0").count() < 5 and mixed.where("doc_id % 3 <> 0").count() > 395
    assert quality.classify(nothing, labels, language.held_out(0, 5)).count() == 0


def test_labels_of_one_kind(odd, labelled):
    _, labels = labelled
    for some, score in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        assert {r["score"] for r in quality.classify(odd, some, language.held_out(0, 5)).collect()} == {score}


def test_long_documents_are_learned_from(spark):
    """Labels that only documents of 30,000 words show are learned, and a bound on passages takes fewer documents."""
    long = lambda k, w: " ".join(f"{w} and {k + i}" for i in range(10_000))
    docs = spark.createDataFrame([(i, long(i, "plain" if i % 2 else "LOUD!!")) for i in range(16)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels, F.lit(False)).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in rows]) == 1
    model = quality.fit(docs, labels, F.lit(False), passages_at_most=2_000)
    assert model.constant is None
    assert quality._within([{"doc_id": i, "label": i % 2, "n": 10} for i in range(8)], 40) == [0, 1, 2, 3]


def test_attention_equals_a_loop_over_documents(labelled):
    """Every document by itself: passages encoded, weighted by gated attention, summed and scored."""
    docs, labels = labelled
    held = language.held_out(0, 5)
    m = quality.fit(docs, labels, held)
    w = m.weights
    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, held).collect()}
    for r in docs.collect():
        x, _ = quality.passages(pa.array([r["text"]]))
        h = [np.tanh((p - m.mean) / m.scale @ w["E"] + w["e"]) for p in x]
        a = np.exp([float((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["w"]) for v in h])
        bag = sum(v * k for v, k in zip(h, a / a.sum(), strict=True))
        assert score[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-float(bag @ w["c"] + w["b"][0]))), abs=1e-5)
