"""Samples, splits and class balancing with exact sizes and repeatable draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.operators.neighbours import nearest
from riskfeat.operators.ordered import number_rows
from riskfeat.runtime import collect_bounded

SLOT_BITS = 12


def sample(df: DataFrame, fraction: float, replace: bool = False, seed: int = 123) -> DataFrame:
    return df.sample(withReplacement=replace, fraction=fraction, seed=seed)


def split_random(df: DataFrame, weights: Sequence[float], seed: int = 42) -> list[DataFrame]:
    return df.randomSplit(list(weights), seed)


def _hash(ids: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])


def split_by_id(df: DataFrame, ids: Sequence[str], test_share: float = 0.2, seed: int = 42, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id: the same row always lands on the same side."""
    in_test = F.pmod(_hash(ids, seed), F.lit(1_000_000)) < int(test_share * 1_000_000)
    return df.where(~in_test).drop(*drop), df.where(in_test).drop(*drop)


def split_time(df: DataFrame, col: str, train_end, test_end) -> tuple[DataFrame, DataFrame]:
    """(train, test): before ``train_end``, and from there up to before ``test_end``; the column leaves."""
    c = F.col(col)
    return df.where(c < train_end).drop(col), df.where((c >= train_end) & (c < test_end)).drop(col)


def take_exactly(df: DataFrame, n: int, ids: Sequence[str], seed: int = 123) -> DataFrame:
    """Exactly ``n`` random rows without replacement: those with the lowest seeded hash of the id.

    Counts per hash range show which ranges belong whole to the sample; only the range that holds the
    n-th row is put in order, so nothing is sorted as a whole.  The id should be unique.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", _hash(ids, seed))
    slot = F.shiftrightunsigned("_h", 64 - SLOT_BITS)
    counts = {r["s"]: r["n"] for r in hashed.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = n
    for edge in sorted(counts):
        if counts[edge] >= left:
            break
        left -= counts[edge]
    else:
        return df
    rest = number_rows(hashed.where(slot == edge), [], ["_h", *ids], "_rn").where(F.col("_rn") <= left).drop("_rn")
    return hashed.where(slot < edge).unionByName(rest).drop("_h")


def _class_sizes(df: DataFrame, label: str) -> tuple[dict, object, object]:
    sizes = {r[label]: r["n"] for r in collect_bounded(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))}
    if len(sizes) != 2:
        raise ValueError(f"two classes are needed, found {sorted(sizes)}")
    minority, majority = sorted(sizes, key=lambda v: (sizes[v], -v if isinstance(v, (int, float)) else 0))
    return sizes, minority, majority


def downsample(df: DataFrame, label: str, ids: Sequence[str], ratio: int = 1, seed: int = 123) -> DataFrame:
    """All minority rows and exactly ratio × as many majority rows."""
    sizes, minority, majority = _class_sizes(df, label)
    part = df.where(F.col(label) == majority)
    return take_exactly(part, min(sizes[minority] * ratio, sizes[majority]), ids, seed).unionByName(df.where(F.col(label) == minority))


def _draws(df: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """(_row, _draw): n draws with replacement of a row number 1 … size."""
    return df.sparkSession.range(n).select(
        (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)) + 1).alias("_row"), F.col("id").alias("_draw")
    )


def upsample(df: DataFrame, label: str, ids: Sequence[str], ratio: int = 1, seed: int = 123) -> DataFrame:
    """All majority rows and exactly majority // ratio minority draws with replacement."""
    sizes, minority, majority = _class_sizes(df, label)
    rows = number_rows(df.where(F.col(label) == minority), [], list(ids), "_row")
    times = _draws(df, sizes[majority] // ratio, sizes[minority], seed).groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    drawn = rows.join(times, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return df.where(F.col(label) == majority).unionByName(drawn.drop("_row", "_times", "_copy"))


def balance(df: DataFrame, label: str, fractions: Mapping, seed: int = 123) -> DataFrame:
    """Each class sampled by its own fraction; above 1 with replacement."""
    parts = [df.where(F.col(label) == v).sample(withReplacement=f > 1, fraction=f, seed=seed) for v, f in fractions.items()]
    return reduce(DataFrame.unionByName, parts)


def holdout(df: DataFrame, train: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows whose id is not in ``train``."""
    return df.join(train.select(*ids), list(ids), "left_anti")


def smote(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 5, seed: int = 123, **limits) -> DataFrame:
    """All rows plus synthetic minority rows up to the majority's size (columns ``cols`` and label).

    Each synthetic row lies between a drawn minority row and one of its k nearest minority rows.
    """
    sizes, minority, majority = _class_sizes(df, label)
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    small = number_rows(df.where(F.col(label) == minority).select(F.col(row_id).alias("id"), vector.alias("features")), [], ["id"], "_row")
    k = min(k, sizes[minority] - 1)
    if k < 1:
        raise ValueError("at least two minority rows are needed")
    near = nearest(small.select("id", "features"), k, **limits)
    other = near.select("id", "rank", "neighbour").join(small.select(F.col("id").alias("neighbour"), F.col("features").alias("_to")), "neighbour")
    draws = _draws(df, sizes[majority] - sizes[minority], sizes[minority], seed).select(
        "_row",
        (F.pmod(F.xxhash64(F.lit(seed + 1), "_draw"), F.lit(k)) + 1).cast("int").alias("rank"),
        (F.pmod(F.xxhash64(F.lit(seed + 2), "_draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_gap"),
    )
    made = draws.join(small, "_row").join(other, ["id", "rank"]).select(
        F.zip_with("features", "_to", lambda a, b: a + (b - a) * F.col("_gap")).alias("_new")
    )
    synthetic = made.select(*[F.col("_new")[i].alias(c) for i, c in enumerate(cols)], F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
    given = df.select(*[F.col(c).cast("double").alias(c) for c in cols], label, F.lit(False).alias("synthetic"))
    return given.unionByName(synthetic)


def edited_neighbours(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 3, of_class=None, **limits) -> DataFrame:
    """Without the majority rows (or the rows of ``of_class``; all rows with "all") that have a
    neighbour of another class among their k nearest."""
    if of_class is None:
        _, _, of_class = _class_sizes(df, label)
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    near = nearest(df.select(F.col(row_id).alias("id"), vector.alias("features")), k, **limits)
    labels = df.select(F.col(row_id).alias("id"), F.col(label).alias("_l"))
    seen = near.join(labels, "id").join(labels.select(F.col("id").alias("neighbour"), F.col("_l").alias("_nl")), "neighbour")
    if of_class != "all":
        seen = seen.where(F.col("_l") == F.lit(of_class))
    wrong = seen.groupBy("id").agg(F.bool_and(F.col("_l") == F.col("_nl")).alias("_ok")).where(~F.col("_ok")).select(F.col("id").alias(row_id))
    return df.join(wrong, row_id, "left_anti")


def smote_enn(df: DataFrame, cols: Sequence[str], label: str, row_id: str, k: int = 5, edit_k: int = 3, seed: int = 123, **limits) -> DataFrame:
    made = smote(df, cols, label, row_id, k, seed, **limits)
    made = made.withColumn("_id", F.xxhash64(*cols, label))
    numbered = number_rows(made, [], ["_id", *cols], "_no").drop("_id")
    return edited_neighbours(numbered, cols, label, "_no", edit_k, "all", **limits).drop("_no")
