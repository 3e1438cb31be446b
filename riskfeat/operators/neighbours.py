"""Exact nearest neighbours by a vector-approximation file.

Every distinct vector is kept as one byte per dimension: the number of the cell it lies in, of CELLS along that
axis.  Two cells bound the distance of their vectors from below and above, by table look-up.  Codes, not vectors,
are cut into blocks along a small tree of axis cuts.  The own block gives a vector an upper bound on the
distance of its k-th neighbour; its code then visits the blocks whose box comes within that bound, and only ids
whose lower bound reaches the k-th upper bound come back.  Vectors are read again for these alone.

Cell borders and the tree come from at most TREE_SAMPLE vectors; that decides how tight the bounds are, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.runtime import collect_bounded, cut_lineage, ship

BLOCK_ROWS = 4_096
MAX_BLOCKS = 200_000
TREE_SAMPLE = 20_000
CELLS = 256
#: Blocks a large table is cut into at least, while they have no more than LARGE_BLOCK rows.
BLOCKS = 32
LARGE_BLOCK = 32_768
PAIRS_AT_ONCE = 2_000_000
#: Pairs whose cells are compared axis by axis at a time.
EXACT_AT_ONCE = 100_000
#: Rows that give a vector without any bound its first one.
FIRST_ROWS = 1_024
#: Beyond any scaled distance.
FAR = 1e9
#: A hair of room, so rounding never rules out a neighbour at exactly the bound.
ROOM = 1 + 1e-9


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col])


def _axis_cuts(points: np.ndarray, leaves: int) -> list:
    """Nested (axis, threshold, low, high); a leaf is None."""
    if leaves <= 1 or len(points) < 2:
        return None
    axis = int(np.argmax(points.max(0) - points.min(0)))
    values = np.unique(points[:, axis])
    if len(values) < 2:
        return None
    at = float(np.median(points[:, axis]))
    at = at if at > values[0] else float(values[1])
    low = points[:, axis] < at
    return [axis, at, _axis_cuts(points[low], leaves // 2), _axis_cuts(points[~low], leaves - leaves // 2)]


def _leaf_numbers(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    stack = [(tree, np.arange(len(points)), 1)]
    while stack:
        node, at, number = stack.pop()
        if node is None or not len(at):
            out[at] = number
            continue
        axis, cut, low, high = node
        mask = points[at, axis] < cut
        stack.append((low, at[mask], number * 2))
        stack.append((high, at[~mask], number * 2 + 1))
    return out


class Points(NamedTuple):
    """Coded vectors: codes, ids, scaled centres of their cells, radii of the cells, squared lengths of the centres."""

    codes: np.ndarray
    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray

    def some(self, lo: int, hi: int) -> Points:
        return Points(*(x[lo:hi] for x in self))


class Cells:
    """Cells along every axis: ``edges`` (dimensions, CELLS + 1), from the least value to the greatest."""

    def __init__(self, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0).T
        even = lo[:, None] + (hi - lo)[:, None] * np.arange(1, CELLS) / CELLS
        # Half by rank and half by width, so that neither crowds nor outliers make cells wide where it counts.
        self.edges = np.concatenate([lo[:, None], np.sort(np.where(np.arange(CELLS - 1) % 2, inner, even), axis=1), hi[:, None]], axis=1)
        self.centres = (self.edges[:, 1:] + self.edges[:, :-1]) / 2
        self.halves = (self.edges[:, 1:] - self.edges[:, :-1]) / 2
        self.axes = np.arange(len(lo))
        self.middle = np.where(np.isfinite(lo + hi), (lo + hi) / 2, 0.0)
        across = float(np.sqrt(((hi - lo) ** 2).sum()))
        self.scale = 1 / across if 0 < across < np.inf else 1.0

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e[1:-1], v, side="right") for e, v in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance of vectors in the cells ``a`` from those in ``b``, row by row."""
        apart = np.abs(self.centres[self.axes, a] - self.centres[self.axes, b])
        reach = self.halves[self.axes, a] + self.halves[self.axes, b]
        return np.sqrt((np.maximum(apart - reach, 0) ** 2).sum(-1)), np.sqrt(((apart + reach) ** 2).sum(-1))

    def rough(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wider bounds of all rows of ``a`` against all of ``b``: the centres' distance less and plus both radii."""
        ca, cb = self.centres[self.axes, a], self.centres[self.axes, b]
        ra, rb = (np.sqrt((self.halves[self.axes, c] ** 2).sum(-1)) for c in (a, b))
        na, nb = (ca * ca).sum(-1), (cb * cb).sum(-1)
        square = na[:, None] + nb[None, :] - 2 * ca @ cb.T
        # The product rounds by a few units of the norms; both bounds are moved apart by more than that.
        slack = 1e-12 * (na[:, None] + nb[None, :])
        radii = ra[:, None] + rb[None, :]
        return np.maximum(np.sqrt(np.maximum(square - slack, 0)) - radii, 0), np.sqrt(np.maximum(square + slack, 0)) + radii

    def points(self, codes: np.ndarray, ids: np.ndarray) -> Points:
        """Rows with the centres of their cells, scaled so that no two vectors are further apart than 1."""
        centres = (self.centres[self.axes, codes] - self.middle) * self.scale
        radii = np.sqrt((self.halves[self.axes, codes] ** 2).sum(-1)) * self.scale
        return Points(codes, ids, centres, radii, (centres * centres).sum(-1))

    def first_reach(self, a: Points, b: Points, k: int) -> np.ndarray:
        """An upper bound of the k-th distance of each row of ``a``, from the first rows of ``b``; ``a`` may be among them."""
        n = min(len(b.ids), FIRST_ROWS)
        if n <= k:
            return np.full(len(a.ids), np.inf)
        _, high = self.rough(a.codes, b.codes[:n])
        return np.partition(high, k, axis=1)[:, k]

    def near(self, a: Points, b: Points, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of a, row of b, lower, upper) of the pairs that can be among the k nearest of ``a``'s rows.

        ``reach`` is known of the k-th distance already.  A pair is out when the centres' distance less both radii is beyond
        it: |a|² + |b|² - 2ab > (reach + radii)², which one single-precision product with three more columns says.  Its
        rounding is at most a few units per column of the norms; both sides have that much room.
        """
        wide = np.minimum(reach * self.scale, FAR) * ROOM + a.radii
        unit = (b.centres.shape[1] + 11) * 2.0**-22
        room_a, room_b = unit * (a.norms + wide**2) + 1e-30, unit * (b.norms + b.radii**2)
        left = np.column_stack([-2 * a.centres, -2 * wide, a.norms - wide**2 - room_a, np.ones(len(wide))]).astype(np.float32)
        right = np.column_stack([b.centres, b.radii, np.ones(len(b.ids)), b.norms - b.radii**2 - room_b]).astype(np.float32)
        value = (left @ right.T).ravel()
        at = np.flatnonzero(value <= 0)
        q, t = np.divmod(at, len(b.ids))
        other = a.ids[q] != b.ids[t]
        at, q, t = at[other], q[other], t[other]
        # Bounds of the centres first, those of the cells for what they leave.
        square = value[at] + (wide[q] + b.radii[t]) ** 2
        radii = a.radii[q] + b.radii[t]
        high = np.sqrt(np.maximum(square + 2 * (room_a[q] + room_b[t]), 0)) + radii
        limit = np.minimum(wide - a.radii, kth_of_each(q, high, len(a.ids), k) * ROOM)
        keep = np.sqrt(np.maximum(square, 0)) - radii <= limit[q] * ROOM
        q, t = q[keep], t[keep]
        low, high = np.empty(len(q)), np.empty(len(q))
        for i in range(0, len(q), EXACT_AT_ONCE):
            some = slice(i, i + EXACT_AT_ONCE)
            low[some], high[some] = self.bounds(a.codes[q[some]], b.codes[t[some]])
        reach = np.minimum(reach, kth_of_each(q, high, len(a.ids), k))
        keep = low <= reach[q] * ROOM
        return q[keep], t[keep], low[keep], high[keep]


def kth_of_each(owner: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th least value of each of ``n`` owners, infinite where there are fewer."""
    order = np.lexsort((value, owner))
    first = np.searchsorted(owner[order], np.arange(n))
    size = np.bincount(owner, minlength=n)
    out = np.full(n, np.inf)
    some = size >= k
    out[some] = value[order][first[some] + k - 1]
    return out


def _codes(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint8).reshape(len(col), -1)


def _steps(n: int, others: int) -> range:
    """Starts of portions of ``n`` rows whose comparisons with ``others`` rows stay within PAIRS_AT_ONCE."""
    return range(0, n, max(1, PAIRS_AT_ONCE // max(1, others)))


def _distinct_vectors(df: DataFrame, k: int) -> DataFrame:
    """(vid, features, ids): each distinct vector once, with its k + 1 lowest row ids."""
    w = Window.partitionBy("features").orderBy("id")
    lowest = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    grouped = lowest.groupBy("features").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("vid"), "features", "ids")


def candidates(df: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors, pairs (vid, near) among which all k nearest neighbours of every vector are).

    ``df`` has ``id`` and ``features`` array<double>; a vector's id is its lowest row id.
    """
    ship(df.sparkSession)
    id_type = df.schema["id"].dataType.simpleString()
    vectors = cut_lineage(_distinct_vectors(df, k))
    n = vectors.count()
    no_pairs = df.sparkSession.createDataFrame([], f"vid {id_type}, near {id_type}")
    seen = vectors.select("features").sample(fraction=min(1.0, TREE_SAMPLE * 2 / max(n, 1)), seed=7).limit(TREE_SAMPLE).collect()
    if not seen:
        return vectors, no_pairs
    # Fewer and larger blocks give closer first bounds and less to shuffle, as a vector's code goes to every block it visits.
    # Beyond some hundred million vectors they grow further; comparisons within them go in portions anyway.
    if block_rows == BLOCK_ROWS:
        block_rows = min(max(block_rows, -(-n // BLOCKS)), LARGE_BLOCK)
    block_rows = max(block_rows, -(-4 * n // MAX_BLOCKS))
    sample = _matrix(pd.Series([r[0] for r in seen]))
    ends = vectors.select(F.posexplode("features").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("axis").collect()
    cells = Cells(sample, np.array([r["lo"] for r in ends]), np.array([r["hi"] for r in ends]))
    tree = _axis_cuts(sample, -(-n // block_rows))

    def to_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["features"])
                yield pd.DataFrame({"vid": b["vid"], "code": [c.tobytes() for c in cells.encode(x)], "leaf": _leaf_numbers(tree, x)})

    leaves = vectors.select("vid", "features").mapInPandas(to_codes, f"vid {id_type}, code binary, leaf bigint")
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")
    # The tree has at most as many leaves as its sample has vectors.
    placed = leaves.join(F.broadcast(parts), "leaf").select("vid", "code", F.concat_ws(":", "leaf", part).alias("block"))
    placed = cut_lineage(placed)

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        x = cells.points(_codes(pdf["code"]), pdf["vid"].to_numpy())
        reach = np.full(len(pdf), np.inf)
        step = _steps(len(pdf), len(pdf)).step
        for lo in range(0, len(pdf), step):
            some = x.some(lo, lo + step)
            first = cells.first_reach(some, x, k)
            q, _, _, high = cells.near(some, x, k, first)
            reach[lo:lo + step] = np.minimum(first, kth_of_each(q, high, len(some.ids), k))
        return pdf.assign(reach=reach)

    bounded = cut_lineage(placed.groupBy("block").applyInPandas(bound, f"vid {id_type}, code binary, block string, reach double"))

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _codes(pdf["code"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lo": [x.min(0).tobytes()], "hi": [x.max(0).tobytes()]})

    boxes = sorted(collect_bounded(placed.groupBy("block").applyInPandas(box, "block string, lo binary, hi binary"), MAX_BLOCKS))
    names = np.array([b["block"] for b in boxes], dtype=object)
    # Two bytes per dimension and block travel to the tasks.
    first, last = (_codes(pd.Series([bytes(b[end]) for b in boxes])) for end in ("lo", "hi"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = cells.edges[cells.axes, first], cells.edges[cells.axes, last.astype(np.int64) + 1]
        for b in batches:
            codes, reach = _codes(b["code"]) if len(b) else None, b["reach"].to_numpy()
            for lo in _steps(len(b), low.size):
                c = codes[lo:lo + _steps(len(b), low.size).step].astype(np.int64)
                under, over = cells.edges[cells.axes, c], cells.edges[cells.axes, c + 1]
                gap = np.maximum(np.maximum(low[None] - over[:, None], under[:, None] - high[None]), 0.0)
                q, t = np.nonzero(np.sqrt((gap * gap).sum(-1)) <= reach[lo:lo + len(c), None] * ROOM)
                part_of = b.iloc[lo + q]
                yield pd.DataFrame({"vid": part_of["vid"].to_numpy(), "code": part_of["code"].to_numpy(), "reach": reach[lo + q], "target": names[t]})

    asked = cut_lineage(bounded.select("vid", "code", "reach").mapInPandas(visits, f"vid {id_type}, code binary, reach double, target string"))
    # Blocks asked by very many vectors are answered by several tasks, each with its own copy.
    loads = F.broadcast(asked.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("copies")))
    asked = asked.join(loads, "target").select("target", F.pmod(F.xxhash64("vid"), F.col("copies")).cast("int").alias("copy"), "vid", "code", "reach")
    held = placed.withColumnRenamed("block", "target").join(loads, "target").select(
        "target", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "vid", "code"
    )

    def answer(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(there):
            queries, rows = (cells.points(_codes(f["code"]), f["vid"].to_numpy()) for f in (asking, there))
            reach = asking["reach"].to_numpy()
            step = _steps(len(asking), len(there)).step
            for lo in range(0, len(asking), step):
                some = queries.some(lo, lo + step)
                q, t, least, most = cells.near(some, rows, k, reach[lo:lo + step])
                found.append(pd.DataFrame({"vid": some.ids[q], "near": rows.ids[t], "least": least, "most": most}))
        return pd.concat(found) if found else pd.DataFrame({"vid": [], "near": [], "least": [], "most": []})

    found = asked.groupBy("target", "copy").cogroup(held.groupBy("target", "copy")).applyInPandas(
        answer, f"vid {id_type}, near {id_type}, least double, most double"
    )
    # What every block found is held against the k-th upper bound over all of them.
    kth = F.array_sort(F.transform("_all", lambda s: s["most"]))[k - 1]
    pool = found.groupBy("vid").agg(F.collect_list(F.struct("near", "least", "most")).alias("_all")).withColumn("_kth", F.coalesce(kth, F.lit(float("inf"))))
    pairs = pool.select("vid", F.explode(F.filter("_all", lambda s: s["least"] <= F.col("_kth") * ROOM)).alias("s")).select("vid", "s.near")
    return vectors, pairs


def nearest(df: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rank, neighbour, distance) for ``df`` (id, features array<double>): the k nearest other
    rows by Euclidean distance, ties by id."""
    df = df.select("id", F.col("features").cast("array<double>").alias("features"))
    vectors, pairs = candidates(df, k, block_rows)
    mine = vectors.select("vid", F.col("features").alias("_a"))
    other = vectors.select(F.col("vid").alias("near"), F.col("features").alias("_b"), "ids")
    squares = F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b))
    measured = pairs.join(other, "near").join(mine, "vid").select("vid", "near", "ids", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("distance"))
    w = Window.partitionBy("vid").orderBy("distance", "near")
    best = measured.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    # Back to rows: the k + 1 lowest ids of the own vector and of each near vector are enough.
    others = best.select("vid", "distance", "ids")
    with_own = others.unionByName(vectors.select("vid", F.lit(0.0).alias("distance"), "ids"))
    pool = with_own.select("vid", F.transform("ids", lambda i: F.struct(F.col("distance").alias("distance"), i.alias("neighbour"))).alias("_s"))
    pool = pool.groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list("_s"))).alias("_pool"))
    owner = df.join(vectors.select("vid", "features"), "features").select("id", "vid")
    chosen = owner.join(pool, "vid").select(
        "id", F.slice(F.filter("_pool", lambda s: s["neighbour"] != F.col("id")), 1, k).alias("_near")
    )
    return chosen.select("id", F.posexplode("_near").alias("pos", "s")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("s.neighbour").alias("neighbour"), F.col("s.distance").alias("distance")
    )
