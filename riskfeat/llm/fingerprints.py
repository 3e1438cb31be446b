"""Document fingerprints from prefix polynomial hashes.

For code points c_0 c_1 … the prefix array holds S_k = sum of (c_i + 1) * B^i for i < k modulo the prime
2^31 - 1, for two bases.  Any two spans are compared with two products: the difference of two entries,
times the other span's power.  The longest common extension of two places is found by binary search
over such comparisons.  A fingerprint keeps the number of code points, the whole hash, and the hashes of
up to SAMPLES prefixes and suffixes whose lengths are multiples of a power of two.

near_edited and near_next compare whole texts: common extensions from both ends, then again from the
spans of WINDOW code points that both texts have between two places where they differ, until none is left
(``alike``).  The likeness of two fingerprints without their texts is a lower bound of that: the share
that their longest common prefix and suffix cover.

Nulls and special cases: a null text is empty; two empty texts are alike; the next document is the one
with the next lower id, for rows with the same id in the order of a hash of their text, null ids last,
and for the last row the first; a single row is followed by itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.base import partitions
from riskfeat.llm.ranges import bounds, with_range

PRIME = (1 << 31) - 1
BASES = (911_382_323, 1_322_837_333)
SAMPLES = 32
#: So many code points, or one text more, are compared at once.
TOGETHER = 1 << 17
#: Length of the spans by which texts that differ at a place find together again; a power of two.
WINDOW = 16
P = np.uint64(PRIME)


class _Powers:
    """B^i modulo PRIME for each of ``bases``, as many as were asked for so far."""

    def __init__(self, bases: list[int]) -> None:
        self.bases = bases
        self.table = np.ones((len(bases), 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while (k := self.table.shape[1]) < n:
            step = np.array([[pow(b, k, PRIME)] for b in self.bases], np.uint64)
            self.table = np.concatenate([self.table, self.table * step % P], axis=1)
        return self.table[:, :n]


POWERS = _Powers([*BASES])
INVERSES = _Powers([pow(b, -1, PRIME) for b in BASES])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a text, for span equality and longest common extensions."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.sums = self._continued(np.zeros((len(BASES), 1), np.uint64), points)

    @staticmethod
    def _continued(sums: np.ndarray, points: np.ndarray) -> np.ndarray:
        at = sums.shape[1] - 1
        terms = (points + np.uint64(1)) * POWERS.upto(at + len(points))[:, at:] % P
        return np.concatenate([sums, sums[:, -1:] + np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)

    def with_tail(self, keep: int, tail: np.ndarray) -> PrefixHash:
        """The hash of the first ``keep`` code points followed by ``tail``."""
        out = PrefixHash.__new__(PrefixHash)
        out.n = keep + len(tail)
        out.sums = self._continued(self.sums[:, :keep + 1], tail)
        return out

    def span(self, i, j) -> np.ndarray:
        """Hashes of [i, j) for each base, which do not depend on i; arrays of places are taken at once."""
        i, j = np.asarray(i), np.asarray(j)
        return (self.sums[:, j] - self.sums[:, i]) % P * INVERSES.upto(int(i.max(initial=0)) + 1)[:, i] % P

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return all(int(a) == int(b) for a, b in zip(self.span(i, i + length), other.span(j, j + length), strict=True))

    def common_extensions(self, i: np.ndarray, other: PrefixHash, j: np.ndarray, most: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Lengths, up to ``most``, of the longest equal spans that begin (``back``: end) at each ``i`` here and ``j`` there."""
        lo, hi = np.zeros(len(i), np.int64), np.array(most, dtype=np.int64)
        while len(k := np.flatnonzero(lo < hi)):
            mid = np.minimum((lo[k] + hi[k] + 1) // 2, 2 * lo[k] + WINDOW)
            ahead, behind = np.where(back[k], 0, mid), np.where(back[k], mid, 0)
            same = (self.span(i[k] - behind, i[k] + ahead) == other.span(j[k] - behind, j[k] + ahead)).all(axis=0)
            lo[k], hi[k] = np.where(same, mid, lo[k]), np.where(same, hi[k], mid - 1)
        return lo

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest equal spans that begin at ``i`` here and at ``j`` there."""
        return int(self.common_extensions(np.array([i]), other, np.array([j]), np.array([min(self.n - i, other.n - j)]), np.array([False]))[0])

    def anchors(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of spans of WINDOW in the parts [begin, end): the least hash of any WINDOW places in
        a row is among them, so that a span of 2 * WINDOW - 1 that two parts share has an anchor that they share."""
        n = np.maximum(end - begin - WINDOW + 1, 0)
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        sums, inverses = self.sums[0], INVERSES.upto(self.n + 1)[0]
        key = (sums[at + WINDOW] - sums[at]) % P * inverses[at] % P
        if len(at) <= WINDOW:
            return at, key
        edge = np.zeros(WINDOW - 1, np.uint64)
        chosen = _sliding(np.concatenate([edge, _sliding(key, np.minimum), edge]), np.maximum) == key
        return at[chosen], key[chosen]


def _sliding(x: np.ndarray, op: np.ufunc) -> np.ndarray:
    """``op`` over every WINDOW values in a row."""
    width = 1
    while width < WINDOW:
        x, width = op(x[:-width], x[width:]), 2 * width
    return x


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = []
    for k, v in enumerate(values):
        i = bisect_left(tails, v)
        before.append(at[i - 1] if i else -1)
        tails[i:i + 1], at[i:i + 1] = [v], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _chain(x_at: np.ndarray, x_id: np.ndarray, y_at: np.ndarray, y_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal anchors in the same order in both texts; the k-th of one id from the front or from
    the back meets the k-th there."""
    ids = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)[1]
    width = max(len(x_id), len(y_id)) + 1
    keys = []
    for part in (ids[:len(x_id)], ids[len(x_id):]):
        order = np.argsort(part, kind="stable")
        n = np.bincount(part, minlength=1)
        rank = np.empty(len(part), np.int64)
        rank[order] = np.arange(len(part)) - (np.cumsum(n) - n)[part[order]]
        keys.append((part * width + rank, part * width + n[part] - 1 - rank))
    found = [np.intersect1d(*k, assume_unique=True, return_indices=True)[1:] for k in zip(*keys, strict=True)]
    a, b = (np.concatenate([at[f[side]] for f in found]) for side, at in enumerate((x_at, y_at)))
    order = np.lexsort((-b, a))
    a, b = a[order], b[order]
    kept = _rising(b.tolist())
    return a[kept], b[kept]


def common_lengths(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Code points in spans that the texts of each pair have in the same order; the pairs are searched together."""
    x, y = (PrefixHash(np.concatenate(v)) for v in (xs, ys))
    x_end, y_end = (np.cumsum([len(t) for t in v]) for v in (xs, ys))
    pair = np.arange(len(xs))
    xa, xb, ya, yb = np.append(0, x_end[:-1]), x_end, np.append(0, y_end[:-1]), y_end
    total = np.zeros(len(xs), np.int64)
    anchors = None
    while True:
        # What each gap begins and ends with alike.
        most = np.minimum(xb - xa, yb - ya)
        ends = np.repeat([False, True], len(xa))
        both = x.common_extensions(np.concatenate([xa, xb]), y, np.concatenate([ya, yb]), np.tile(most, 2), ends)
        front, back = both[:len(xa)], np.minimum(both[len(xa):], most - both[:len(xa)])
        np.add.at(total, pair, front + back)
        left = most - front - back >= WINDOW
        xa, xb, ya, yb, pair = (v[left] for v in (xa + front, xb - back, ya + front, yb - back, pair))
        if not len(xa) or (anchors is not None and not (front + back).any()):
            return total
        if anchors is None:
            (x_at, x_key), (y_at, y_key) = x.anchors(xa, xb), y.anchors(ya, yb)
            ids = np.unique(np.concatenate([x_key, y_key]), return_inverse=True)[1]
            anchors = (x_at, ids[:len(x_at)]), (y_at, ids[len(x_at):])
            n_ids = len(ids)
        # Anchors that both texts have within a gap part it.
        inside = []
        for (at, ids), lo, hi in zip(anchors, (xa, ya), (xb, yb), strict=True):
            gap = np.searchsorted(lo, at, "right") - 1
            here = (gap >= 0) & (at + WINDOW <= hi[gap])
            inside += [at[here], gap[here] * n_ids + ids[here]]
        a, b = _chain(*inside)
        if not len(a):
            return total
        pair = np.concatenate([pair, pair[np.searchsorted(xa, a, "right") - 1]])
        xa, xb, ya, yb = (np.concatenate(v) for v in ((xa, a), (xb, a), (ya, b), (yb, b)))
        xa, xb, ya, yb, pair = (np.sort(v) for v in (xa, xb, ya, yb, pair))


def alike(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """For each pair of texts 1 if equal, else the share of the longer one that spans common to both, in the
    same order, cover."""
    shared = common_lengths(xs, ys)
    n, m = (np.array([len(t) for t in v]) for v in (xs, ys))
    longest = np.maximum(n, m)
    return np.where((n == m) & (shared == n), 1.0, np.minimum(shared, longest - 1) / np.maximum(longest, 1))


class Fingerprint:
    """Length, whole hash, and sampled prefix and suffix hashes of a text."""

    def __init__(self, n: int, whole: tuple[int, int], prefixes: np.ndarray, suffixes: np.ndarray) -> None:
        self.n, self.whole, self.prefixes, self.suffixes = n, whole, prefixes, suffixes

    @classmethod
    def of(cls, h: PrefixHash) -> Fingerprint:
        stride = sample_stride(h.n)
        at = np.arange(stride, h.n + 1, stride)
        zero = np.zeros(len(at), np.int64)
        a, b = h.span(0, h.n)
        first = h.span(np.concatenate([zero, h.n - at]), np.concatenate([at, zero + h.n]))[0].astype("<u4")
        return cls(h.n, (int(a), int(b)), first[:len(at)], first[len(at):])

    def __str__(self) -> str:
        samples = base64.b64encode(self.prefixes.tobytes() + self.suffixes.tobytes()).decode()
        return f"{self.n:x}:{self.whole[0]:08x}{self.whole[1]:08x}:{samples}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, samples = text.split(":")
        values = np.frombuffer(base64.b64decode(samples), dtype="<u4")
        k = len(values) // 2
        return cls(int(n, 16), (int(whole[:8], 16), int(whole[8:], 16)), values[:k], values[k:])

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal texts, else the share of the longer text that common prefix and suffix cover."""
        longest, shortest = max(self.n, other.n), min(self.n, other.n)
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not shortest:
            return 0.0
        stride = max(sample_stride(self.n), sample_stride(other.n))
        same = [
            _common(x[stride // sample_stride(self.n) - 1::stride // sample_stride(self.n)], y[stride // sample_stride(other.n) - 1::stride // sample_stride(other.n)])
            for x, y in ((self.prefixes, other.prefixes), (self.suffixes, other.suffixes))
        ]
        return min(sum(same) * stride, shortest, longest - 1) / longest


def sample_stride(n: int) -> int:
    """The smallest power of two that gives at most SAMPLES multiples up to ``n``."""
    return 1 << max(0, (max(n, 1) // (SAMPLES + 1)).bit_length())


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading samples agree: a shorter prefix agrees wherever a longer one does."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
    return lo


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double"
)


def _rows(pending: list[tuple]) -> pa.RecordBatch:
    """SCHEMA for (doc_id, text, code points, fingerprint, the next row's text and code points)."""
    rows, changed = [], []
    for doc_id, text, points, f, after_text, after_points in pending:
        half = len(points) // 2
        changed.append(np.concatenate([points[:len(points) - half], after_points[:half]]))
        sha = hashlib.sha256((text[:len(text) - half] + after_text[:half]).encode()).hexdigest()
        rows.append((doc_id, len(points), sha, f, str(Fingerprint.of(PrefixHash(changed[-1])))))
    own = [p[2] for p in pending]
    likeness = [alike(own, other) if pending else np.zeros(0) for other in (changed, [p[5] for p in pending])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)] + [pa.array(v) for v in likeness]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(",")])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each range in order, its last row being the first of the range that follows."""
    held, pending, size = None, [], 0
    for batch in batches:
        for chunk, is_peek, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            points = code_points(text)
            if held is not None and held[0] == chunk:
                pending.append((*held[1:], text, points))
                size += len(points)
            held = None if is_peek else (chunk, doc_id, text, points, str(Fingerprint.of(PrefixHash(points))))
            if size >= TOGETHER:
                yield _rows(pending)
                pending, size = [], 0
    yield _rows(pending)


def fingerprints(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row of ``docs`` (doc_id, text): its fingerprint, that of its text with the second
    half replaced by the next document's beginning, and how alike they and the next document's are."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n_rows, n_ids, least = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
    cuts = bounds(rows, "doc_id", n_rows, min(n_rows, 4 * partitions(spark)))
    if n_ids == n_rows:
        # Range 0 holds null ids and what lies below the first cut: without either there is no such range.
        cuts = [c for c in cuts if float(c) > float(least)]
    n_chunks = len({float(c) for c in cuts}) + 1
    placed = with_range(rows, "doc_id", cuts, "chunk").withColumn("_tie", F.xxhash64("text"))
    # The first row of every range in descending order also ends the range before it.
    top = placed.groupBy("chunk").agg(F.max("doc_id").alias("_top"))
    on = (F.col("chunk") == F.col("_chunk")) & F.col("doc_id").eqNullSafe(F.col("_top"))
    heads = placed.join(F.broadcast(top.withColumnRenamed("chunk", "_chunk")), on, "left_semi")
    heads = heads.groupBy("chunk").agg(F.min(F.struct("_tie", "text", "doc_id")).alias("_h"))
    peeks = heads.select(
        "_h.doc_id", "_h.text", ((F.col("chunk") + 1) % n_chunks).cast("int").alias("chunk"), "_h._tie", F.lit(True).alias("is_peek")
    )
    both = placed.withColumn("is_peek", F.lit(False)).unionByName(peeks)
    ordered = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "is_peek", F.desc_nulls_last("doc_id"), "_tie")
    return ordered.select("chunk", "is_peek", "doc_id", "text").mapInArrow(_stream, SCHEMA)
