"""Many logistic models in one pass over the rows: penalty grids, folds, class weights, feature subsets.

Every pass sums the loss, the gradient and the second derivatives of all open models together, so a grid of
candidates and folds costs the passes of its slowest model.  Partitions send one row of sums per model and Spark adds
them up; the driver holds (columns + 1)² numbers per model, whatever the number of rows, and takes one Newton step for
each.  Absolute penalties are met exactly, by coordinate descent on the quadratic of the step.

Rows with a label other than 0 and 1, or with a column that is null, NaN or infinite, are left out.  A model whose
rows hold one class only, or none, has null coefficients and null areas.  A column without variance has coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.runtime import drop_folder, shared_folder, ship

#: Number of the models that learn from all rows, in the place of the fold that is left out.
ALL_ROWS = -1
MAX_STEPS = 100
#: A model is done when its next step promises less than this share of its objective.
TOLERANCE = 1e-14
#: Up to so many columns, the intercept's too, products of columns are made once for all models.
PRODUCT_COLUMNS = 16
#: Bytes of the margins that a pass works on at a time.
IN_CACHE = 1 << 18
#: Factors of one logarithm.
LOG_AT_ONCE = 512
#: Rows whose scores are sorted at a time, and rows of a range of scores, about.
SCORES, POINTS = 1 << 17, 1 << 20
#: Ranges of a table of more rows than that, at least: a task hands on small pieces.
RANGES = 160
#: Rows that the ranges of scores are taken from.
RANGED = 20_000
#: Subsets of an elimination that are fitted side by side.
AHEAD = 16


@dataclass(frozen=True)
class Candidate:
    """Penalty, its absolute share (0: squares only, 1: absolute only) and weights of the classes 0 and 1."""

    reg: float = 0.0
    mixing: float = 0.0
    weights: tuple[float, float] | str = (1.0, 1.0)


class Sweep(NamedTuple):
    """``coefficients``: (candidate, fold, feature, coefficient), fold -1 for the models of all rows.
    ``areas``: (candidate, fold, area) on the fold that was left out."""

    coefficients: DataFrame
    areas: DataFrame
    passes: int


@dataclass
class _Fit:
    """One model and where its steps have come to; the last column is the intercept."""

    left_out: int
    weights: tuple[float, float]
    absolute: np.ndarray
    squares: np.ndarray
    active: np.ndarray
    trial: np.ndarray
    at: np.ndarray | None = None
    objective: float = np.inf
    curvature: np.ndarray | None = None
    halvings: int = 0
    done: bool = False
    #: Inverse curvature as foreseen from a larger model, until the model has a curvature of its own.
    foreseen: np.ndarray | None = field(default=None, repr=False)

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Take in what a pass has found at ``trial`` and choose the next place."""
        b = self.trial
        value = loss + float(np.sum(self.absolute * np.abs(b)) + np.sum(self.squares * b * b) / 2)
        if value > self.objective + 1e-13 * (1 + abs(self.objective)):
            self.halvings += 1
            self.trial = (self.at + b) / 2
            self.done = self.halvings > 40
            return
        self.at, self.objective, self.halvings = b, value, 0
        self.curvature = curvature + np.diag(self.squares)
        slope = gradient + self.squares * b
        step = np.zeros_like(b)
        if np.any(self.absolute[self.active] > 0):
            step = _descend(slope, self.curvature, b, self.absolute, self.active)
        else:
            k = np.flatnonzero(self.active)
            step[k] = np.linalg.lstsq(self.curvature[np.ix_(k, k)], -slope[k], rcond=1e-14)[0]
        self.trial = b + step
        gain = -(slope @ step + step @ self.curvature @ step / 2 + np.sum(self.absolute * (np.abs(self.trial) - np.abs(b))))
        self.done = gain <= TOLERANCE * (1 + abs(value))

    def inverse(self) -> np.ndarray:
        if self.curvature is None:
            return self.foreseen
        k = np.flatnonzero(self.active)
        out = np.zeros_like(self.curvature)
        out[np.ix_(k, k)] = np.linalg.pinv(self.curvature[np.ix_(k, k)], hermitian=True)
        return out


def _descend(slope: np.ndarray, curvature: np.ndarray, start: np.ndarray, absolute: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Step that minimises the quadratic plus the absolute penalties, one coordinate after the other."""
    step = np.zeros_like(start)
    own = np.diag(curvature)
    places = [int(j) for j in np.flatnonzero(active) if own[j] > 0]
    pull = slope.copy()
    for _ in range(10_000):
        largest = 0.0
        for j in places:
            free = start[j] + step[j] - pull[j] / own[j]
            new = np.sign(free) * max(abs(free) - absolute[j] / own[j], 0.0)
            change = new - start[j] - step[j]
            if change != 0.0:
                step[j] += change
                pull += change * curvature[:, j]
                largest = max(largest, abs(change) * np.sqrt(own[j]))
        if largest < 1e-13:
            break
    return step


class _Rows:
    """The rows to learn from, written once: columns as doubles, label 0 or 1, fold."""

    def __init__(self, df: DataFrame, cols: Sequence[str], label: str, fold) -> None:
        ship(df.sparkSession)
        self.spark, self.width, self.passes = df.sparkSession, len(cols), 0
        self.names = [f"x{i}" for i in range(len(cols))]
        rows = df.select(
            *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(cols, self.names)],
            F.col(f"`{label}`").cast("double").alias("label"), fold.cast("int").alias("fold"),
        )
        usable = F.col("label").isin(0.0, 1.0)
        for x in self.names:
            # An infinite value less itself is NaN, which Spark holds equal to NaN only.
            usable = usable & ((F.col(x) - F.col(x)) == 0.0)
        self.folder = shared_folder(self.spark, "fit-rows")
        chosen = rows.where(usable)
        chosen.write.parquet(f"{self.folder}/rows")
        self.table = self.spark.read.schema(chosen.schema).parquet(f"{self.folder}/rows")
        self._describe()

    def _describe(self) -> None:
        """Rows, means and squared deviations by fold and class: two rows a fold."""
        measures = [F.count(F.lit(1)).alias("n")]
        measures += [F.avg(x).alias(f"m_{x}") for x in self.names] + [F.var_pop(x).alias(f"v_{x}") for x in self.names]
        got = self.table.groupBy("fold", "label").agg(*measures).collect()
        self.fold = np.array([r["fold"] for r in got], dtype=int)
        self.cls = np.array([int(r["label"]) for r in got], dtype=int)
        self.n = np.array([float(r["n"]) for r in got])
        self.mean = np.array([[r[f"m_{x}"] for x in self.names] for r in got], dtype=float).reshape(len(got), self.width)
        self.var = np.array([[r[f"v_{x}"] for x in self.names] for r in got], dtype=float).reshape(len(got), self.width)
        self.centre, spread = self.spread_of(np.ones(len(got)))
        self.scale = np.where(spread > 0, spread, 1.0)

    def spread_of(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted means and standard deviations of the columns, one weight per fold and class."""
        w = weight * self.n
        total = w.sum()
        if total <= 0:
            return np.zeros(self.width), np.zeros(self.width)
        mean = w @ self.mean / total
        squares = w @ (self.var + (self.mean - mean) ** 2)
        degrees = total - (weight * weight * self.n).sum() / total
        return mean, np.sqrt(squares / degrees) if degrees > 0 else np.zeros(self.width)

    def fit(self, candidate: Candidate, left_out: int, standardize: bool) -> _Fit | None:
        """A model before its first step, or None where its rows do not hold both classes."""
        used = self.fold != left_out
        sizes = [float(self.n[used & (self.cls == c)].sum()) for c in (0, 1)]
        if min(sizes) == 0:
            return None
        given = [sum(sizes) / (2 * s) for s in sizes] if candidate.weights == "balanced" else [float(w) for w in candidate.weights]
        weight = np.where(used, np.take(given, self.cls), 0.0)
        total = float((weight * self.n).sum())
        _, spread = self.spread_of(weight)
        # Rows are scaled by the whole table's spread; the penalty is that of the coefficients asked for.
        factor = (spread if standardize else np.ones(self.width)) / self.scale
        active = np.append(spread > 0, True)
        start = np.zeros(self.width + 1)
        start[-1] = np.log(given[1] * sizes[1]) - np.log(given[0] * sizes[0])
        return _Fit(
            left_out, (given[0] / total, given[1] / total), np.append(candidate.reg * candidate.mixing * factor, 0.0),
            np.append(candidate.reg * (1 - candidate.mixing) * factor**2, 0.0), active, start,
        )

    def step(self, fits: Sequence[_Fit]) -> None:
        """One pass: every open model takes a step."""
        open_fits = [f for f in fits if not f.done]
        if not open_fits:
            return
        self.passes += 1
        size = self.width + 1
        upper = np.triu_indices(size)
        sums = _sums(self.names, self.centre, self.scale, open_fits)
        parts = self.table.mapInPandas(sums, "fit int, sums array<double>")
        # Added up place by place: no task holds the sums of all partitions.
        whole = parts.select("fit", F.posexplode("sums").alias("place", "x")).groupBy("fit", "place").agg(F.sum("x").alias("x")).toArrow()
        got = np.zeros((len(open_fits), 1 + size + len(upper[0])))
        got[whole["fit"].to_numpy(), whole["place"].to_numpy()] = whole["x"].to_numpy()
        for f, row in zip(open_fits, got):
            curvature = np.zeros((size, size))
            curvature[upper] = row[1 + size :]
            curvature = curvature + curvature.T - np.diag(np.diag(curvature))
            f.take(float(row[0]), row[1 : 1 + size], curvature)

    def coefficients(self, fit: _Fit) -> np.ndarray:
        """Coefficients of the columns as they were given, and the intercept."""
        slopes = fit.trial[:-1] / self.scale
        return np.append(slopes, fit.trial[-1] - slopes @ self.centre)

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


def _sums(names: Sequence[str], centre: np.ndarray, scale: np.ndarray, fits: Sequence[_Fit]):
    """Function over a partition's rows: one row of sums per model."""
    places = np.column_stack([f.trial for f in fits])
    left_out = np.array([f.left_out for f in fits])
    weights = np.array([f.weights for f in fits])
    names = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, models = len(names) + 1, len(left_out)
        upper = np.triu_indices(size)
        loss = np.zeros(models)
        gradient = np.zeros((size, models))
        curvature = np.zeros((models, len(upper[0])))
        few = size <= PRODUCT_COLUMNS
        step = max(1, IN_CACHE // (8 * models))
        for b in batches:
            z = np.ones((len(b), size))
            z[:, :-1] = (b[names].to_numpy(dtype=float) - centre) / scale
            cls, fold = b["label"].to_numpy().astype(int), b["fold"].to_numpy()
            # Rows of one fold and class have the same models, and one weight in each.
            for f in np.unique(fold):
                learn = np.flatnonzero(left_out != f)
                for c in (0, 1):
                    at = np.flatnonzero((fold == f) & (cls == c))
                    if not len(learn) or not len(at):
                        continue
                    w, side = weights[learn, c], 1.0 - 2.0 * c
                    found = _of_class(z[at] * side, places[:, learn], step, upper if few else None)
                    loss[learn] += w * found[0]
                    gradient[:, learn] += w * found[1]
                    curvature[learn] += w[:, None] * found[2]
        rows = [np.concatenate([[loss[k]], gradient[:, k], curvature[k]]) for k in range(models)]
        yield pd.DataFrame({"fit": np.arange(models, dtype="int32"), "sums": rows})

    return run


def _of_class(z: np.ndarray, places: np.ndarray, step: int, upper: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and upper second derivatives per model of rows that pull one way: log(1 + exp(z · place)).

    ``step`` rows at a time, so that what is between stays in a core's cache.  With ``upper`` all models share the products of
    the columns.
    """
    size, models = places.shape
    loss, gradient = np.zeros(models), np.zeros((size, models))
    triangle = np.triu_indices(size)
    curvature = np.zeros((models, len(triangle[0])))
    for k in range(0, len(z), step):
        part = z[k:k + step]
        margin = part @ places
        # One exponential a margin; it cannot overflow, and small tails keep their digits.
        tail = np.exp(-np.abs(margin))
        whole = 1.0 + tail
        # Factors of at most 2: the product of LOG_AT_ONCE of them is a number, and needs one logarithm.
        for c in range(0, len(part), LOG_AT_ONCE):
            loss += np.log(np.multiply.reduce(whole[c:c + LOG_AT_ONCE], axis=0))
        loss += np.maximum(margin, 0.0).sum(axis=0)
        near = np.divide(1.0, whole, out=whole)
        tail *= near
        p = np.where(margin >= 0, near, tail)
        gradient += part.T @ p
        tail *= near
        if upper is not None:
            curvature += tail.T @ (part[:, upper[0]] * part[:, upper[1]])
            continue
        for m in range(models):
            curvature[m] += (part.T @ (tail[:, m, None] * part))[triangle]
    return loss, gradient, curvature


# --- grids ------------------------------------------------------------------------------------


def grid(reg: Sequence[float] = (0.0,), mixing: Sequence[float] = (0.0,), weights: Sequence = ((1.0, 1.0),)) -> list[Candidate]:
    return [Candidate(r, m, w) for r in reg for m in mixing for w in weights]


def _distinct(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores by falling size, with their numbers of both classes; NaN is one score, the largest."""
    order = np.argsort(score)[::-1]
    score = score[order]
    if not len(score):
        return score, pos, neg
    new = (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
    first = np.flatnonzero(np.r_[True, new])
    return score[first], np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)


def _areas(rows: DataFrame, names: Sequence[str], models: Sequence[tuple[int, int, list[float], float]], n_rows: float) -> DataFrame:
    """(candidate, fold, area): each row is scored by the models (candidate, fold, slopes, intercept) that did not see its
    fold; ties count half.

    A task sorts the scores it has, adds up equal ones and deals them out by ranges; a range's points come together sorted, and
    what ranges add to each other follows from their sums.  The ranges are quantiles of some rows' scores: they
    say where a point is counted and nothing about the area.
    """
    names, models = list(names), list(models)
    ranges = max(RANGES, int(n_rows // POINTS)) if n_rows > POINTS else 1

    def scores(x: list[np.ndarray], slopes: list[float], intercept: float) -> np.ndarray:
        with np.errstate(all="ignore"):
            return reduce(lambda total, i: total + slopes[i] * x[i], range(len(names)), np.full(len(x[0]), intercept))

    some = rows.sample(min(1.0, RANGED / max(n_rows, 1.0)), seed=7).limit(2 * RANGED).toArrow() if ranges > 1 else None
    borders = []
    for _, _, slopes, intercept in models:
        found = scores([some.column(x).to_numpy() for x in names], slopes, intercept) if some is not None and some.num_rows else np.zeros(0)
        found = np.sort(found[np.isfinite(found)])
        # A score belongs to the first range whose lower end it reaches; ranges go by falling scores.
        borders.append(np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else np.zeros(0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            x = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            one, fold = (np.concatenate([h[i] for h in held]) for i in (-2, -1))
            dealt = []
            for m, (_, k, slopes, intercept) in enumerate(models):
                at = np.flatnonzero(fold == k)
                if not len(at):
                    continue
                pos = one[at].astype(np.int64)
                score, pos, neg = _distinct(scores([v[at] for v in x], slopes, intercept), pos, 1 - pos)
                part = len(borders[m]) - np.searchsorted(borders[m], score, side="right")
                part[np.isnan(score)] = 0
                ends = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                dealt += [(m, int(part[a]), score[a:b].tobytes(), pos[a:b].tobytes(), neg[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*dealt), kinds)], ["model", "part", "score", "pos", "neg"]) if dealt else empty

        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], ["model", "part", "score", "pos", "neg"])
        for b in batches:
            held.append((*[b.column(x).to_numpy() for x in names], b.column("label").to_numpy() == 1.0, b.column("fold").to_numpy()))
            n += b.num_rows
            if n >= SCORES:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per (model, part), whose rows follow each other: its numbers of both classes, and its pairs in the right order."""
        current, held, points, least, done = None, [], 0, 0, []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _distinct(*(np.concatenate([h[i] for h in held]) for i in range(3)))

        def close() -> None:
            if current is not None:
                _, pos, neg = merged()
                above = np.cumsum(pos)
                done.append((*current, int(pos.sum()), int(neg.sum()), float(np.sum(neg * (above - pos / 2)))))

        for b in batches:
            for m, part, score, pos, neg in zip(*(b.column(c).to_pylist() for c in ("model", "part", "score", "pos", "neg"))):
                if (m, part) != current:
                    close()
                    current, held, points, least = (m, part), [], 0, 0
                held.append((np.frombuffer(score), np.frombuffer(pos, np.int64), np.frombuffer(neg, np.int64)))
                points += len(held[-1][0])
                if points > 2 * least + POINTS:
                    held = [merged()]
                    points = least = len(held[0][0])
        close()
        if done:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["model", "part", "pos", "neg", "half"])

    pieces = rows.select(*names, "label", "fold").mapInArrow(deal, "model int, part int, score binary, pos binary, neg binary")
    together = pieces.repartition("model", "part").sortWithinPartitions("model", "part")
    sums = together.mapInArrow(add_up, "model int, part int, pos bigint, neg bigint, half double")
    above = Window.partitionBy("model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    half = F.sum(F.col("half") + F.col("neg").cast("double") * F.col("above"))
    whole = sums.withColumn("above", F.coalesce(F.sum("pos").over(above), F.lit(0))).groupBy("model").agg(
        F.try_divide(half, F.sum("pos").cast("double") * F.sum("neg")).alias("area")
    )
    named = rows.sparkSession.createDataFrame([(m, c, k) for m, (c, k, _, _) in enumerate(models)], "model int, candidate int, fold int")
    return whole.join(F.broadcast(named), "model").select("candidate", "fold", "area")


def logistic_sweep(
    df: DataFrame, cols: Sequence[str], label: str, row_id: Sequence[str], candidates: Sequence[Candidate], folds: int = 3,
    standardize: bool = True, max_steps: int = MAX_STEPS,
) -> Sweep:
    """Cross-validated logistic models of all candidates, and each candidate's model of all rows.

    A row's fold is a hash of its id, so rows with equal ids, null ids too, share a fold.  With ``standardize``
    penalties apply to coefficients of columns scaled by their standard deviation in the model's rows.
    """
    fold = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in row_id]), F.lit(folds))
    rows = _Rows(df, cols, label, fold)
    try:
        fits = {(c, k): rows.fit(cand, k, standardize) for c, cand in enumerate(candidates) for k in (ALL_ROWS, *range(folds))}
        for _ in range(max_steps):
            rows.step([f for f in fits.values() if f is not None])
            if all(f is None or f.done for f in fits.values()):
                break
        values = {at: None if f is None else [float(x) for x in rows.coefficients(f)] for at, f in fits.items()}
        named = [*cols, "intercept"]
        table = [(c, k, a, None if v is None else v[i]) for (c, k), v in values.items() for i, a in enumerate(named)]
        spark = df.sparkSession
        coefficients = spark.createDataFrame(table, "candidate int, fold int, feature string, coefficient double")
        models = [(c, k, v[:-1], v[-1]) for (c, k), v in values.items() if v is not None and k != ALL_ROWS]
        # At most one row per candidate and fold.
        areas = {(r["candidate"], r["fold"]): r["area"] for r in _areas(rows.table, rows.names, models, rows.n.sum()).collect()}
        found = [(c, k, areas.get((c, k))) for c in range(len(candidates)) for k in range(folds)]
        return Sweep(coefficients, spark.createDataFrame(found, "candidate int, fold int, area double"), rows.passes)
    finally:
        rows.drop()


# --- recursive elimination --------------------------------------------------------------------


def _without(fit: _Fit, j: int) -> _Fit:
    """The model without column ``j``: where its quadratic is least, and its inverse by a block update."""
    inverse, own = fit.inverse(), fit.inverse()[j, j]
    active = fit.active.copy()
    active[j] = False
    start = fit.trial.copy()
    if own > 0:
        start = start - inverse[:, j] * (start[j] / own)
        inverse = inverse - np.outer(inverse[:, j], inverse[j]) / own
    start[~active] = 0.0
    return _Fit(fit.left_out, fit.weights, fit.absolute, fit.squares, active, start, foreseen=inverse)


def _weakest(rows: _Rows, fit: _Fit, left: Sequence[int]) -> int:
    """The column of the smallest coefficient; of equal ones (nine digits) the first."""
    size = np.abs(rows.coefficients(fit)[:-1])[list(left)]
    return left[int(np.argmin(np.round(size / max(size.max(), 1e-300), 9)))]


def eliminate(df: DataFrame, cols: Sequence[str], label: str, n: int, reg: float = 1e-3, ahead: int = AHEAD) -> tuple[list[str], int]:
    """Columns in the order in which they leave until ``n`` are left, and the number of passes.

    The weakest coefficient leaves.  Up to ``ahead`` subsets that are expected next are fitted in the same
    passes, each from the place that the larger model's quadratic foresees; a subset that turns out wrong is
    replaced.  A column leaves only when the model that says so is fitted to the end.  Rows of one class: the last
    columns leave first.
    """
    rows = _Rows(df, cols, label, F.lit(0))
    try:
        first = rows.fit(Candidate(reg), ALL_ROWS, standardize=False)
        left, order = list(range(len(cols))), []
        if first is None:
            return [cols[j] for j in reversed(left[max(n, 0):])], rows.passes
        path = [first]
        while len(left) > n:
            rows.step(path)
            while path and path[0].done and len(left) > n:
                gone = _weakest(rows, path[0], left)
                left.remove(gone)
                order.append(gone)
                done = path.pop(0)
                if not path or _holds(path[0], done, gone) is False:
                    path = [_without(done, gone)]
            _foresee(rows, path, left, n, ahead)
        return [cols[j] for j in order], rows.passes
    finally:
        rows.drop()


def _holds(smaller: _Fit, larger: _Fit, j: int) -> bool:
    """Whether ``smaller`` is ``larger`` without column ``j``."""
    want = larger.active.copy()
    want[j] = False
    return bool(np.array_equal(smaller.active, want))


def _foresee(rows: _Rows, path: list[_Fit], left: Sequence[int], n: int, ahead: int) -> None:
    """Bring the expected subsets in line with the models' present places, and add to them."""
    there = list(left)
    for k in range(min(ahead, len(left) - n)):
        if k > 0:
            gone = _weakest(rows, path[k - 1], there)
            there.remove(gone)
            if k == len(path) or not _holds(path[k], path[k - 1], gone):
                del path[k:]
                path.append(_without(path[k - 1], gone))
