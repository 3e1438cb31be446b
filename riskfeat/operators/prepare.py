"""Missing values, scaling, selection, principal components, vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.columns import nan_free
from riskfeat.operators.quantiles import exact_quantiles
from riskfeat.operators.stats import corr_expr, long_features, per_column
from riskfeat.operators.sweeps import eliminate
from riskfeat.runtime import collect_bounded


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=None if cols is None else list(cols))


def medians(df: DataFrame, cols: Sequence[str], missing: float | None = None) -> dict[str, float]:
    """Exact median per column; values equal to ``missing`` count as missing too."""
    values = long_features(df, [], cols)
    if missing is not None:
        values = values.where(F.col("value") != missing)
    return {k[0]: q[0.5] for k, q in exact_quantiles(values, ["feature"], "value", [0.5]).items()}


def fill_median(
    df: DataFrame, cols: Sequence[str], missing: float | None = None, rest_zero: bool = False
) -> DataFrame:
    """Missing values of each column replaced by its median, as doubles.

    With ``rest_zero`` what then is still missing (columns without any value) becomes 0.
    """
    mid = medians(df, cols, missing)

    def filled(c: str):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v) & (v != missing) if missing is not None else ~F.isnan(v), v)
        out = F.coalesce(v, F.lit(mid[c])) if c in mid else v
        return F.coalesce(out, F.lit(0.0)) if rest_zero else out

    return df.withColumns({c: filled(c) for c in cols})


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values replaced by the most frequent one, the lowest of equally frequent ones."""
    if not cols:
        return df
    types = dict(df.dtypes)
    text = [c for c in cols if types[c] in ("string", "boolean", "date") or types[c].startswith("timestamp")]
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"`{c}`").cast("string").alias("_v")) for c in cols])
    counts = df.select(F.inline(pairs)).where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    number = F.when(~F.col("_c").isin(text), F.expr("try_cast(_v AS double)")) if text else F.expr("try_cast(_v AS double)")
    best = counts.groupBy("_c").agg(F.min(F.struct(-F.col("_n"), number, "_v")).alias("_b"))
    # One row per listed column.
    modes = {r["_c"]: r["_v"] for r in best.select("_c", "_b._v").collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c]).cast(types[c])) for c in cols if c in modes})


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """To 0 … 1; a column that does not vary becomes 0."""
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in collect_bounded(per_column(
        df, cols, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")}
    ))}

    def scaled(c):
        lo, hi = bounds[c]
        v = F.col(c).cast("double")
        if lo is None:
            return v
        return F.when(v.isNotNull(), F.lit(0.0)) if lo == hi else (v - F.lit(lo)) / F.lit(hi - lo)

    return df.withColumns({c: scaled(c) for c in cols})


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minus the mean, over the population deviation; a column that does not vary becomes 0."""
    stats = {r["column"]: (r["m"], r["s"]) for r in collect_bounded(per_column(df, cols, {"m": F.avg, "s": F.stddev_pop}))}

    def scaled(c):
        m, s = stats[c]
        v = F.col(c).cast("double")
        if m is None:
            return v
        return (v - F.lit(m)) / F.lit(s) if s else v - F.lit(m)

    return df.withColumns({c: scaled(c) for c in cols})


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, {"variance": F.var_pop}, "feature")


def variance_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.8 * (1 - 0.8)) -> DataFrame:
    """Without the listed columns whose population variance is not above the limit."""
    low = collect_bounded(variances(df, cols).where(~(F.col("variance") > limit) | F.col("variance").isNull()))
    return df.drop(*[r["feature"] for r in low])


# --- principal components ---------------------------------------------------------------------


def _centred(df: DataFrame, cols: Sequence[str]):
    steps = [VectorAssembler(inputCols=list(cols), outputCol="_raw"),
             StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False)]
    return Pipeline(stages=steps).fit(df)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int) -> tuple[PipelineModel, PCAModel]:
    """The model projects without centring, so its input is centred first."""
    centre = _centred(df, cols)
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centre.transform(df))
    return centre, model


def component_grid(n_features: int, points: int = 50) -> list[int]:
    return sorted({int(x) for x in np.linspace(n_features, 1, num=points)})


def pca_components(df: DataFrame, cols: Sequence[str], share: float = 0.98) -> int:
    """Smallest number of components on a 50-point grid whose explained share is above ``share``.

    One fit with all components gives the share for every number on the grid.
    """
    _, model = pca_fit(df, cols, len(cols))
    explained = np.cumsum(model.explainedVariance.toArray())
    enough = [k for k in component_grid(len(cols)) if explained[k - 1] > share]
    return enough[0] if enough else len(cols)


def pca_project(df: DataFrame, cols: Sequence[str], pc1: int, pc2: int, label: str) -> DataFrame:
    """(x, y, label) in two components, counted from 0."""
    centre, model = pca_fit(df, cols, max(pc1, pc2) + 1)
    pc = vector_to_array("_pc")
    return model.transform(centre.transform(df)).select(pc[pc1].alias("x"), pc[pc2].alias("y"), F.col(label).alias("label"))


def pca_loadings(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(feature, component, loading); components are counted from 0."""
    _, model = pca_fit(df, cols, k)
    m = model.pc.toArray()
    rows = [(c, j, float(m[i, j])) for i, c in enumerate(cols) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


# --- indexing, vectors, encoding ---------------------------------------------------------------


def index_strings(df: DataFrame, cols: Sequence[str], suffix: str = "_idx") -> PipelineModel:
    """Fitted indexers: most frequent first, ties by name; unknown and missing get one more index."""
    stages = [StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols], handleInvalid="keep")]
    return Pipeline(stages=stages).fit(df)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def one_hot(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """0/1 column per value of a bin column, named <col>_<value>; as many columns as there are values."""
    if values is None:
        values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in values])


def f_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, f): linear F-test of each column against the label, nulls left out pairwise."""
    y = F.col(label).cast("double")
    found = per_column(
        nan_free(df, [*cols, label]), cols, {"r": lambda c: corr_expr(c.cast("double"), y), "n": lambda c: F.count(F.when(y.isNotNull(), c))}, "feature"
    )
    r2 = F.col("r") * F.col("r")
    return found.select("feature", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f"))


def select_k_best(df: DataFrame, cols: Sequence[str], label: str, k: int) -> DataFrame:
    return f_scores(df, cols, label).orderBy(F.desc_nulls_last("f"), "feature").limit(k)


def recursive_elimination(df: DataFrame, cols: Sequence[str], label: str, n: int) -> DataFrame:
    """(feature, ranking): the weakest coefficient leaves until ``n`` features stay at rank 1."""
    dropped, _ = eliminate(df, cols, label, n)
    rows = [(c, 1) for c in cols if c not in dropped] + [(c, i + 2) for i, c in enumerate(reversed(dropped))]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int")
