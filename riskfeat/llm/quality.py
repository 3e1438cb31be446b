"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Each passage is described by the bytes and words it
is made of and encoded by a small layer; gated attention gives every passage a weight, and the weighted
sum of the encodings is scored.  Encoder, attention and scorer are learned together from labels of
whole documents by gradient descent.

The model is fitted on about PER_CLASS documents of each label, drawn by a hash of their id, in whole texts.  Where these
hold more than PASSAGES passages, fewer documents are taken, in the order of that hash and whatever their
length.  Every document is scored on its whole text.

Nulls and special cases: a null or empty text is one empty passage; labels without id or quality are
ignored, several labels of one id count by their mean; ids held out are never learned from, a null id is
not held out; equal texts get equal scores; with labels of one kind only, or none, every score is the
share of label 1, or 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfeat.llm.words import NOT_BLANK, Words, give_back, slices, text_bytes
from riskfeat.runtime import stored

PASSAGE = 64
WORD_BINS = 64
PER_CLASS = 1_500
PASSAGES = 150_000
ACCEPT = 0.3

#: Kinds of bytes: letters, digits, beyond ASCII, line feeds, other blanks, and every mark by itself.
KIND = np.zeros(256, dtype=np.int64)
KIND[[i for i in range(0x80) if chr(i).isupper()]] = 1
KIND[0x30:0x3A] = 2
KIND[0x80:] = 3
KIND[0x0A] = 4
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
MARKS = [i for i in range(0x21, 0x7F) if not chr(i).isalnum()]
KIND[MARKS] = 6 + np.arange(len(MARKS))
KINDS = 6 + len(MARKS)
FEATURES = KINDS + WORD_BINS + 4


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages of a slice of texts, first passage of each text and the end)."""
    words = Words(texts, NOT_BLANK)
    raw, at = text_bytes(texts)
    n_words = np.diff(words.bounds)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.append(0, np.cumsum(n_passages))
    total = int(first[-1])
    owner = first[words.doc] + (np.arange(len(words)) - words.bounds[words.doc]) // PASSAGE
    # A passage's bytes run from its first word to the next passage's; a text's first passage starts with it.
    begins = np.repeat(at[:-1], n_passages)
    lead = np.flatnonzero(np.diff(owner, prepend=-1)) if len(words) else np.zeros(0, int)
    inner = lead[(lead - words.bounds[words.doc[lead]]) > 0]
    begins[owner[inner]] = words.start[inner]
    n_bytes = np.diff(np.append(begins, len(raw)))
    of_byte = np.repeat(np.arange(total), n_bytes)
    kinds = np.bincount(of_byte * KINDS + KIND[raw], minlength=total * KINDS).reshape(total, KINDS)
    bins = np.bincount(owner * WORD_BINS + (words.hash >> np.uint64(58)).astype(np.int64), minlength=total * WORD_BINS).reshape(total, WORD_BINS)
    count = np.bincount(owner, minlength=total)
    letters = np.bincount(owner, weights=(words.end - words.start), minlength=total)
    order = np.lexsort((words.hash, owner))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (np.diff(owner[order]) != 0) | (words.hash[order][1:] != words.hash[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=total)
    some = np.maximum(count, 1)
    x = np.concatenate([
        np.sqrt(kinds / np.maximum(n_bytes, 1)[:, None]), np.sqrt(bins / some[:, None]),
        np.stack([np.log1p(letters / some), distinct / some, count / PASSAGE, np.repeat(np.log1p(n_passages), n_passages)], axis=1),
    ], axis=1)
    return x.astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of encoder, gated attention and scorer, or a constant where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    @classmethod
    def fresh(cls, x: np.ndarray, hidden: int = 32, gate: int = 16, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"E": make(x.shape[1], hidden), "e": np.zeros(hidden, np.float32), "V": make(hidden, gate), "U": make(hidden, gate),
             "w": make(gate), "c": make(hidden), "b": np.zeros(1, np.float32)}
        return cls(x.mean(0), np.maximum(x.std(0), 0.02), w)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = (t * g) @ w["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
        a = a / np.add.reduceat(a, first[:-1])[bag]
        m = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return _sigmoid(m @ w["c"] + w["b"]), (z, h, t, g, a, bag, m)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        return np.full(n, self.constant) if self.constant is not None else self.forward(x, first)[0].astype(float) if n else np.zeros(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        p, (z, h, t, g, a, bag, m) = self.forward(x, first)
        d = ((p - y) / len(y)).astype(np.float32)
        dm = d[:, None] * w["c"]
        da = np.einsum("ij,ij->i", dm[bag], h)
        ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = a[:, None] * dm[bag] + dt @ w["V"].T + dg @ w["U"].T
        de = dh * (1 - h * h)
        return {"E": z.T @ de, "e": de.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": m.T @ d, "b": d.sum(keepdims=True)}

    def train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 11) -> None:
        """Adam on the cross-entropy of whole documents."""
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.weights.items()}
        two = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                some = order[lo:lo + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                bounds = np.append(0, np.cumsum(first[some + 1] - first[some]))
                step += 1
                for k, grad in self.gradients(x[rows], bounds, y[some]).items():
                    one[k] = 0.9 * one[k] + 0.1 * grad
                    two[k] = 0.999 * two[k] + 0.001 * grad * grad
                    move = one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * (move + decay * self.weights[k])).astype(np.float32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for lo, hi in slices(texts):
            x, first = passages(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(np.diff(first)),
                pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
            ], ["doc_id", "label", "n", "features"])


def _within(sizes: list, most: int) -> list[int]:
    """Ids in the given order while each label's passages stay within half of ``most``; one of each label at least."""
    chosen, sums = [], {}
    for r in sizes:
        before = sums.get(r["label"], 0)
        sums[r["label"]] = before + r["n"]
        if before == 0 or sums[r["label"]] <= most // 2:
            chosen.append(r["doc_id"])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, passages_at_most: int = PASSAGES) -> Model:
    """Learn from ``labels`` (doc_id, quality) of documents that are not ``held`` (a condition on doc_id)."""
    known = labels.where(~held & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = np.zeros((1, FEATURES), np.float32)
    if set(sizes) != {0, 1}:
        return Model(empty[0], empty[0] + 1, {}, constant=float(max(sizes)) if sizes else 0.5)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("label") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    # About two times per_class rows, whatever the number of labels.
    drawn = known.where(lot < share)
    described = stored(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "text", F.col("label").cast("bigint").alias("label"))
        .mapInArrow(_describe, "doc_id bigint, label bigint, n bigint, features binary"), "passages")
    # A few thousand rows of sizes decide which documents are brought to the driver.
    sized = described.groupBy("doc_id", "label").agg(F.sum("n").alias("n")).withColumn("lot", lot).collect()
    chosen = _within(sorted(sized, key=lambda r: (r["lot"], r["doc_id"])), passages_at_most)
    rows = described.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id bigint")), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["features"])))
    y = np.array([r["label"] for r in rows], dtype=np.float32)
    if len(set(y)) < 2:
        return Model(empty[0], empty[0] + 1, {}, constant=float(y.mean()) if len(y) else 0.5)
    x = np.concatenate([np.frombuffer(r["features"], dtype=np.float32).reshape(-1, FEATURES) for r in rows])
    model = Model.fresh(x)
    model.train(x, np.append(0, np.cumsum([r["n"] for r in rows])), y)
    # The classes were drawn alike; the last weight moves the scores back to the labels' own shares.
    drawn_odds, odds = y.sum() / (len(y) - y.sum()), sizes[1] / sizes[0]
    model.weights["b"] = (model.weights["b"] + np.log(odds / drawn_odds)).astype(np.float32)
    return model


def _scorer(model, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every row as it came, with the score of its column number ``at`` added; portions of bounded bytes go out as they are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for lo, hi in slices(texts):
                x, first = passages(texts.slice(lo, hi - lo))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.score(x, first))], [*part.schema.names, "score"])
        give_back()

    return run


def with_scores(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, out: str = "score") -> DataFrame:
    """``docs`` with the scores in column ``out``, which must be a new name."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held, per_class))
    # Columns go by number, since names may hold dots.
    numbered = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    schema = T.StructType([*numbered.schema.fields, T.StructField("score", T.DoubleType())])
    return numbered.mapInArrow(_scorer(model, docs.columns.index("text")), schema).toDF(*docs.columns, out)


def accepted(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected."""
    out = "_quality_score"
    return with_scores(docs, labels, held, per_class, out).where(F.col(out) >= accept).drop(out)


def classify(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    scored = with_scores(rows, labels, held, per_class)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))
