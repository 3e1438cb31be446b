"""Quantile and entropy bins, weight of evidence, information value."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.functions.columns import log_ratio
from riskfeat.operators.ordered import running_totals, with_neighbours
from riskfeat.operators.prepare import medians
from riskfeat.operators.quantiles import exact_quantiles, quantile_rows
from riskfeat.operators.stats import feature_profile, long_features
from riskfeat.runtime import broadcast_if_small, same, stored

MISSING_BIN = -1


# --- quantile bins ----------------------------------------------------------------------------


def quantile_edge_rows(values: DataFrame, keys: list[str], cells: int = 10, value: str = "value", weight: str | None = None) -> DataFrame:
    """(keys…, edges): edges for the largest number of cells, at most ``cells``, without repeated edges.

    The quantiles of all cell numbers are found together.
    """
    shares = sorted({i / k for k in range(1, cells + 1) for i in range(k + 1)})
    at = {f: F.col("_q")[i] for i, f in enumerate(shares)}
    tries = [F.array(*[at[i / k] for i in range(k + 1)]) for k in range(cells, 1, -1)]
    edges = [F.when(F.size(F.array_distinct(e)) == F.size(e), e) for e in tries]
    return quantile_rows(values, keys, value, shares, "_q", weight).select(*keys, F.coalesce(*edges, F.array(at[0.0], at[1.0])).alias("edges"))


def _edges_passed(value: Column, most: int, passed) -> Column:
    """How many of the at most ``most`` edges in the column ``_edges`` the value has passed."""
    hits = [F.when(passed(value, F.get("_edges", F.lit(i))), 1).otherwise(0) for i in range(most)]
    count = reduce(lambda a, b: a + b, hits, F.lit(0))
    return F.when(value.isNull() | F.isnan(value), MISSING_BIN).otherwise(count)


def quantile_bins(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), cells: int = 10) -> DataFrame:
    """Long form (keep…, feature, value, bin) with at most ``cells`` quantile bins per feature."""
    return _binned(long_features(df, list(keep), cols), ["feature"], cells)


def _binned(values: DataFrame, keys: list[str], cells: int, weight: str | None = None) -> DataFrame:
    edges = stored(quantile_edge_rows(values, keys, cells, weight=weight), "edges")
    inner = edges.select(*keys, F.slice("edges", F.lit(2), F.size("edges") - 2).alias("_edges"))
    # Bins (a, b] counted from 0.
    table = broadcast_if_small(inner).alias("b")
    joined = values.alias("a").join(table, same(keys), "left")
    return joined.select("a.*", _edges_passed(F.col("value"), cells - 1, lambda v, e: v > e).alias("bin"))


def woe_table(binned: DataFrame, label: str, keys: Sequence[str] = ("feature",), sign: str = "event", weight: str | None = None) -> DataFrame:
    """Per key and bin: min, max, events, total, shares, WOE and IV.

    ``sign`` "event" takes ln(event share / non-event share), "good" the opposite; the IV is the same.
    A bin without events or without non-events has an infinite WOE and IV.  With ``weight`` a row stands for as many
    equal rows as that column says.
    """
    keys, n = list(keys), F.lit(1).cast("bigint") if weight is None else F.col(weight)
    shown = F.when(F.col("bin") == MISSING_BIN, F.lit(float(MISSING_BIN))).otherwise(F.col("value"))
    y = F.col(label).cast("bigint")
    bins = binned.groupBy(*keys, "bin").agg(
        F.min(shown).alias("bin_min"), F.max(shown).alias("bin_max"), F.sum(y * n).alias("events"), F.sum(n).alias("total")
    )
    totals = bins.groupBy(*keys).agg(F.sum("events").alias("_e"), F.sum(F.col("total") - F.col("events")).alias("_n"))
    joined = bins.alias("a").join(totals.alias("b"), same(keys)).select("a.*", "_e", "_n")
    event = F.try_divide(F.col("events"), F.col("_e"))
    nonevent = F.try_divide(F.col("total") - F.col("events"), F.col("_n"))
    shares = joined.withColumns({"event_pct": event, "nonevent_pct": nonevent}).drop("_e", "_n")
    evidence = log_ratio("event_pct", "nonevent_pct")
    diff = F.col("event_pct") - F.col("nonevent_pct")
    return shares.withColumns({"woe": evidence if sign == "event" else -evidence, "iv": diff * evidence})


def quantile_woe(df: DataFrame, cols: Sequence[str], label: str, cells: int = 10) -> DataFrame:
    """Good/bad view of quantile bins; bad rate and ln(good share / bad share), bin max plus 0.1."""
    t = woe_table(quantile_bins(df, cols, [label], cells), label, sign="good")
    whole = F.lit(1) * F.col("total")
    per = t.groupBy("feature").agg(F.sum("total").alias("_t"))
    return t.join(per, "feature").select(
        "feature", "bin", (F.col("total") - F.col("events")).alias("good"), F.col("events").alias("bad"), "total",
        F.col("bin_min").alias("min"), (F.col("bin_max") + 0.1).alias("max"),
        F.col("nonevent_pct").alias("good_pct"), F.col("event_pct").alias("bad_pct"),
        F.try_divide(whole, F.col("_t")).alias("total_pct"),
        F.try_divide(F.col("events"), F.col("total")).alias("bad_rate"), "woe", "iv",
    )


def bin_report(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """(keys…, cell, default, total, bin_max, bin_min) for export."""
    return table.select(*keys, F.col("bin").alias("cell"), F.col("events").alias("default"), "total", "bin_max", "bin_min")


def bad_rate(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    return table.select(*keys, "bin", F.try_divide(F.col("events"), F.col("total")).alias("bad_rate"))


def total_iv(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    return table.groupBy(*keys).agg(F.sum("iv").alias("iv"))


def iv_summary(df: DataFrame, cols: Sequence[str], label: str, cells: int = 10) -> DataFrame:
    """(feature, missing, zero, n_unique, iv)."""
    iv = total_iv(woe_table(quantile_bins(df, cols, [label], cells), label))
    return feature_profile(df, cols).join(iv, "feature")


def select_by_iv(iv: DataFrame, limit: float = 0.0) -> DataFrame:
    """Features whose IV reaches the limit; undefined ones drop out, infinite ones stay."""
    return iv.where((F.col("iv") >= limit) & ~F.isnan("iv"))


def _filled(v: Column, fill: str, mid: Column) -> Column:
    """``v`` filled one way; a null ``mid`` is that of a column without median."""
    if fill == "median":
        v = F.coalesce(F.nullif(v, F.lit(0.0)), mid)
    return F.coalesce(v, F.lit(0.0)) if fill in ("zero", "median") else v


def fill_variants(df: DataFrame, cols: Sequence[str], fills: Sequence[str], numeric: Sequence[str] | None = None) -> dict[str, dict[str, Column]]:
    """Per fill name the column expressions: none keeps nulls, zero and median replace them.

    The median ignores zeros and replaces them too, for the ``numeric`` columns; the rest is zero.
    """
    numeric = list(cols if numeric is None else numeric)
    mid = medians(df, numeric, missing=0) if "median" in fills else {}
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return {fill: {c: _filled(number(c), fill, F.lit(mid.get(c)).cast("double")) for c in cols} for fill in fills}


def value_counts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, value, _n): how often each value comes per key, stored; nulls and NaN are values too."""
    return stored(values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n")), "value-counts")


def _sweep_counts(df, cols, label, segment, fills, numeric) -> DataFrame:
    """(segment, label, fill, feature, value, _n).  Filling changes a value whatever its row, so the rows are counted once
    and the counted values are filled in each way."""
    given = long_features(df, [F.col(segment).alias("segment"), F.col(label).alias(label)], cols)
    value = F.col("value")
    counts = value_counts(given.withColumn("value", F.when(~F.isnan(value), value)), ["segment", label, "feature"])
    mid = F.lit(None).cast("double")
    if "median" in fills:
        numbers = counts.where(F.col("feature").isin(list(cols if numeric is None else numeric)) & (value != 0))
        for (feature,), q in exact_quantiles(numbers, ["feature"], "value", [0.5], "_n").items():
            mid = F.when(F.col("feature") == feature, F.lit(q[0.5])).otherwise(mid)
    filled = F.array(*[F.struct(F.lit(f).alias("fill"), _filled(value, f, mid).alias("value")) for f in fills])
    return counts.select("segment", label, "feature", "_n", F.inline(filled))


def iv_sweep(
    df: DataFrame, cols: Sequence[str], label: str, segment: str, fills: Sequence[str] = ("none", "zero", "median"),
    method: str = "quantile", cells: int = 10, numeric: Sequence[str] | None = None,
) -> DataFrame:
    """(segment, fill, feature, iv) for every segment and fill method, from one long table of counted values."""
    keys = ["segment", "fill", "feature"]
    counts = _sweep_counts(df, cols, label, segment, fills, numeric)
    if method == "quantile":
        return total_iv(woe_table(_binned(counts, keys, cells, "_n"), label, keys, weight="_n"), keys)
    return total_iv(_tree_table(counts, keys, label, missing="bin"), keys)


# --- entropy bins -----------------------------------------------------------------------------


def _nh(good: Column, bad: Column) -> Column:
    """n times the entropy of the label, in nats."""
    n = good + bad

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / n)).otherwise(0.0)

    return -(part(good) + part(bad))


def value_histogram(values: DataFrame, keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    """Distinct values per key with the good and bad rows up to each, and the next value.

    Computed and stored once; every split of every leaf is then plain arithmetic on it.
    """
    y, n = F.col(label).cast("int"), F.lit(1).cast("bigint") if weight is None else F.col(weight)
    of = lambda cls: F.sum(F.when(y == cls, n).otherwise(0))
    present = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    hist = stored(present.groupBy(*keys, "value").agg(of(0).alias("_g"), of(1).alias("_b")))
    summed = running_totals(hist, keys, ["value"], {"_cg": "_g", "_cb": "_b"})
    ahead = with_neighbours(summed, keys, ["value"], ["value"], None, "_next")
    return stored(ahead.select(*keys, "value", F.col("_next.value").alias("_next"), "_g", "_b", "_cg", "_cb"))


def tree_edge_rows(values: DataFrame, keys: list[str], label: str, leaves: int = 6, min_share: float = 0.05, weight: str | None = None) -> DataFrame:
    """(keys…, edges): bin edges per key from a best-first entropy tree over one feature, for any number of keys.

    The open leaves of all keys are a table, the frontier.  Each round finds the best cut of the leaves made in the
    round before by one join with the histogram and one aggregate; a window over the few open leaves of a key then
    chooses the one with the largest gain (equal gains: the lowest cut), which becomes two leaves.  Rounds end when
    no key has a leaf left to cut.  A cut has to gain something, in 9 decimals.  Keys without values have no row.
    """
    hist = value_histogram(values, keys, label, weight)
    ends = stored(hist.groupBy(*keys).agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.max("_cg").alias("_lg"), F.max("_cb").alias("_lb")
    ), "ends")
    # A leaf: values in [_lo, _hi), rows up to its start, its own rows, and the rows that a side of a cut needs.
    leaf = ["_lo", "_hi", "_g0", "_b0", "_lg", "_lb", "_need"]
    zero = F.lit(0).cast("bigint")
    fresh = ends.select(
        *keys, F.lit(-math.inf).alias("_lo"), F.lit(math.inf).alias("_hi"), zero.alias("_g0"), zero.alias("_b0"), "_lg", "_lb",
        F.ceil(F.lit(min_share) * (F.col("_lg") + F.col("_lb"))).alias("_need"),
    )
    gl, bl = F.col("_cg") - F.col("_g0"), F.col("_cb") - F.col("_b0")
    gr, br = F.col("_lg") - gl, F.col("_lb") - bl
    gain = F.round(_nh(F.col("_lg"), F.col("_lb")) - _nh(gl, bl) - _nh(gr, br), 9)
    cut = F.col("value") + (F.col("_next") - F.col("value")) / 2
    inside = (F.col("a.value") >= F.col("_lo")) & (F.col("a.value") < F.col("_hi")) & (F.col("a._next") < F.col("_hi"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_best.gain"), "_best.cut")
    waiting, chosen = None, []
    for _ in range(leaves - 1):
        able = fresh.where((F.col("_lg") > 0) & (F.col("_lb") > 0) & (F.col("_lg") + F.col("_lb") >= 2 * F.col("_need")))
        tried = hist.alias("a").join(broadcast_if_small(able).alias("b"), same(keys) & inside)
        # Highest gain, then the lowest cut.
        found = (
            tried.where((gl + bl >= F.col("_need")) & (gr + br >= F.col("_need")))
            .select(*[F.col(f"a.`{k}`").alias(k) for k in keys], *leaf, F.struct(gain.alias("gain"), cut.alias("cut"), "_cg", "_cb").alias("_try"))
            .groupBy(*keys, *leaf).agg(F.max_by("_try", F.struct(F.col("_try.gain"), -F.col("_try.cut"))).alias("_best"))
            .where(F.col("_best.gain") > 0)
        )
        frontier = found if waiting is None else waiting.unionByName(found)
        frontier = stored(frontier.withColumn("_nth", F.row_number().over(order)), "frontier")
        first = frontier.where(F.col("_nth") == 1)
        if first.isEmpty():
            break
        chosen.append(first.select(*keys, F.col("_best.cut").alias("_cut")))
        waiting = frontier.where(F.col("_nth") > 1).drop("_nth")
        g, b = F.col("_best._cg") - F.col("_g0"), F.col("_best._cb") - F.col("_b0")
        left = F.struct("_lo", F.col("_best.cut").alias("_hi"), "_g0", "_b0", g.alias("_lg"), b.alias("_lb"), "_need")
        right = F.struct(
            F.col("_best.cut").alias("_lo"), "_hi", F.col("_best._cg").alias("_g0"), F.col("_best._cb").alias("_b0"),
            (F.col("_lg") - g).alias("_lg"), (F.col("_lb") - b).alias("_lb"), "_need",
        )
        fresh = first.select(*keys, F.inline(F.array(left, right)))
    outer = F.array("_min", F.col("_max") + 0.1)
    if not chosen:
        return ends.select(*keys, F.array_sort(F.array_distinct(outer)).alias("edges"))
    cuts = reduce(DataFrame.unionByName, chosen).groupBy(*keys).agg(F.collect_list("_cut").alias("_cuts"))
    all_edges = F.when(F.col("_cuts").isNull(), outer).otherwise(F.concat(outer, "_cuts"))
    joined = ends.alias("a").join(cuts.alias("b"), same(keys), "left")
    return joined.select(*[F.col(f"a.`{k}`").alias(k) for k in keys], F.array_sort(F.array_distinct(all_edges)).alias("edges"))


def tree_boundaries(df: DataFrame, cols: Sequence[str], label: str, leaves: int = 6, min_share: float = 0.05) -> DataFrame:
    """(feature, edges) with bins [a, b)."""
    return tree_edge_rows(long_features(df, [label], cols), ["feature"], label, leaves, min_share)


def _tree_table(counts: DataFrame, keys: list[str], label: str, missing: str, leaves: int = 6, min_share: float = 0.05) -> DataFrame:
    """The bins of values with their counts ``_n``; edges and bins are both made from the counts, not from the rows."""
    edges = stored(tree_edge_rows(counts, keys, label, leaves, min_share, "_n"), "edges")
    inner = edges.select(*keys, F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("_edges"))
    bin_of = _edges_passed(F.col("value"), leaves - 1, lambda v, e: v >= e)
    binned = counts.alias("a").join(broadcast_if_small(inner).alias("b"), same(keys), "left").select("a.*", bin_of.alias("bin"))
    if missing == "drop":
        binned = binned.where(F.col("bin") != MISSING_BIN)
    return woe_table(binned, label, keys, "good", "_n")


def tree_woe(
    df: DataFrame, cols: Sequence[str], label: str, missing: str = "drop", leaves: int = 6, min_share: float = 0.05
) -> DataFrame:
    """Good/bad table over entropy bins; nulls are left out, or are their own bin -1 with missing="bin"."""
    counts = value_counts(long_features(df, [label], cols), [label, "feature"])
    t = _tree_table(counts, ["feature"], label, missing, leaves, min_share)
    per = t.groupBy("feature").agg(F.sum("total").alias("_t"))
    return t.join(per, "feature").select(
        "feature", "bin", (F.col("total") - F.col("events")).alias("good"), F.col("events").alias("bad"), "total",
        F.col("bin_min").alias("min"), F.col("bin_max").alias("max"),
        F.col("nonevent_pct").alias("good_pct"), F.col("event_pct").alias("bad_pct"),
        F.try_divide(F.col("total"), F.col("_t")).alias("total_pct"),
        F.try_divide(F.col("events"), F.col("total")).alias("bad_rate"), "woe", "iv",
    )
