"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  Every text is cut into windows
of about WINDOW bytes, and each window is compressed twice: after the ordinary dictionary alone, and after
both.  The bytes that the toxic dictionary saves are the window's gain.  Text that is common everywhere gains
nothing, since the ordinary dictionary is there in both; only what toxic text alone repeats does.

Training goes in ROUNDS.  Ordinary windows that gained wrongly are put into the ordinary dictionary, and the
toxic dictionary is trained anew on the windows of toxic texts that gained.

A document is its histogram of gains.  Thresholds are calibrated on documents that no dictionary was trained
on: each gain gets the log-likelihood ratio of toxic against ordinary windows, and a logistic
regression turns their sum, peak and number into a probability.

The model is fitted on a bounded sample: about PER_CLASS documents of each label, drawn by a hash of their id, two
thirds for the dictionaries (of them about SAMPLE_WINDOWS windows of each label, drawn by a hash of their
content and place) and one third, in whole texts, for the thresholds.  Every document is scored on its whole text.

Nulls and special cases: a null or empty text is one empty window; labels without id or value are
ignored, several labels of one id count by their mean; ids held out are never learned from, a null id is
not held out; equal texts get equal scores; with labels of one kind only, or none, every score is the
share of label 1, or 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 48
LEVEL = 5
ORDINARY_BYTES, TOXIC_BYTES, CORRECTED_BYTES = 1 << 16, 1 << 13, 1 << 17
ROUNDS = 5
PER_CLASS = 1_500
SAMPLE_WINDOWS = 100_000
TOXIC = 0.7
#: Gains are counted from -LEAST to MOST bytes; those beyond count as the outermost.
LEAST, MOST = 8, 12
BINS = LEAST + MOST + 1


def windows(text: bytes) -> list[bytes]:
    """The whole text in pieces that end before the first blank after WINDOW bytes, or after twice as many."""
    out, lo = [], 0
    while lo < len(text):
        hi = text.find(b" ", lo + WINDOW, lo + 2 * WINDOW)
        if hi < 0:
            hi = min(lo + 2 * WINDOW, len(text))
        out.append(text[lo:hi])
        lo = hi
    return out or [b""]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses after ``content``; frames carry nothing but the data, so lengths compare."""
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the segments that ``samples`` repeat; their end where they are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=50, d=6, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        plain, both = compressor(self.ordinary).compress, compressor(self.toxic + self.ordinary).compress
        return np.array([len(plain(w)) - len(both(w)) for w in pieces], dtype=np.int64)

    def histogram(self, text: bytes) -> np.ndarray:
        return np.bincount(np.clip(self.gains(windows(text)), -LEAST, MOST) + LEAST, minlength=BINS)


def train(ordinary: list[bytes], toxic: list[bytes], rounds: int = ROUNDS) -> Dictionaries:
    base = trained(ordinary, ORDINARY_BYTES)
    corrections: list[bytes] = []
    samples = toxic
    for k in range(rounds):
        found = Dictionaries(b" ".join(corrections)[-CORRECTED_BYTES:] + base, trained(samples, TOXIC_BYTES))
        if k == rounds - 1:
            break
        wrong = found.gains(ordinary)
        # The worst come first, and so furthest from the end of the dictionary that is always kept: later rounds add to them.
        corrections += [ordinary[i] for i in np.argsort(-wrong, kind="stable") if wrong[i] >= 1]
        if k:
            right = found.gains(toxic)
            samples = [w for w, g in zip(toxic, right, strict=True) if g >= 1] or toxic
    return found


@dataclass(frozen=True)
class Model:
    """Dictionaries and thresholds, or a constant where nothing could be learned."""

    dictionaries: Dictionaries | None = None
    ratios: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.5

    @staticmethod
    def summary(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """What is known of documents with these histograms: mean, balanced and largest evidence, and size."""
        n = counts.sum(axis=1)
        total = counts @ ratios
        peak = np.where(counts > 0, ratios, -np.inf).max(axis=1, initial=-np.inf)
        gained = counts[:, LEAST + 1:].sum(axis=1)
        return np.stack([total / np.sqrt(n), total / n, peak, np.log(n), gained / n, np.log1p(gained)], axis=1)

    @classmethod
    def calibrated(cls, dictionaries: Dictionaries, counts: np.ndarray, y: np.ndarray, odds: float) -> Model:
        """Thresholds from histograms of documents of either label; ``odds`` of label 1 among all labels."""
        def shares(some: np.ndarray) -> np.ndarray:
            all_windows = some.sum(axis=0) + 1.0
            return np.log(all_windows / all_windows.sum())

        ratios = shares(counts[y == 1]) - shares(counts[y == 0])
        x = cls.summary(counts, ratios)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.append((x - mean) / scale, np.ones((len(x), 1)), axis=1)
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        # Both labels were drawn alike; the constant moves scores to the labels' own shares.
        w[-1] += np.log(odds) - np.log(y.sum() / (len(y) - y.sum()))
        return cls(dictionaries, ratios, mean, scale, w)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.dictionaries is None or not texts:
            return np.full(len(texts), self.constant)
        counts = np.stack([self.dictionaries.histogram((t or "").encode()) for t in texts])
        z = (self.summary(counts, self.ratios) - self.mean) / self.scale
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            pieces = windows((text.as_py() or "").encode())
            lots = [xxhash.xxh3_64_intdigest(w, seed=k) / 2.0**64 for k, w in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * len(pieces), pa.bool_()), pa.array(pieces, pa.binary()), pa.array(lots)], ["label", "piece", "lot"])


def _histogram_rows(dictionaries: Dictionaries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [dictionaries.histogram((t or "").encode()).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(counts, pa.list_(pa.int64()))], ["label", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of documents that are not ``held`` (a condition on doc_id)."""
    known = labels.where(~held & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("toxic") >= 0.5).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {False, True}:
        return Model(constant=float(max(sizes)) if sizes else 0.5)

    def lot(seed: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)

    # About two times per_class rows, whatever the number of labels.
    drawn = known.where(lot(1) < F.when(F.col("label"), per_class / sizes[True]).otherwise(per_class / sizes[False]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    for_thresholds = lot(2) * 3 < 1
    pieces = texts.where(~for_thresholds).select("text", "label").mapInArrow(_window_rows, "label boolean, piece binary, lot double")
    numbers = {r["label"]: r["n"] for r in pieces.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label"), sample_windows / max(1, numbers.get(True, 0))).otherwise(sample_windows / max(1, numbers.get(False, 0)))
    rows = sorted((r["lot"], bytes(r["piece"]), r["label"]) for r in pieces.where(F.col("lot") < share).collect())
    dictionaries = train([w for _, w, toxic in rows if not toxic], [w for _, w, toxic in rows if toxic])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    held_back = texts.where(for_thresholds).select("text", "label").mapInArrow(lambda b: _histogram_rows(shared.value)(b), "label boolean, counts array<bigint>").collect()
    if len({r["label"] for r in held_back}) < 2:
        # Too few labels for thresholds of their own: the documents that trained the dictionaries set them.
        held_back = texts.select("text", "label").mapInArrow(lambda b: _histogram_rows(shared.value)(b), "label boolean, counts array<bigint>").collect()
    if len({r["label"] for r in held_back}) < 2:
        return Model(constant=sizes[True] / (sizes[True] + sizes[False]))
    held_back = sorted(held_back, key=lambda r: (r["label"], r["counts"]))
    counts, y = np.array([r["counts"] for r in held_back], dtype=float), np.array([float(r["label"]) for r in held_back])
    return Model.calibrated(dictionaries, counts, y, sizes[True] / sizes[False])


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, held: Column, per_class: int = PER_CLASS, toxic: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held, per_class))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    scored = rows.mapInArrow(_scorer(model), "doc_id bigint, held_out boolean, score double")
    return scored.select("*", (F.col("score") >= toxic).cast("int").alias("predicted"))
