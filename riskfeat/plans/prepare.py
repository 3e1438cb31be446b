"""Missing values, scaling and selection on a feature table with made gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import prepare as P
from riskfeat.plans.base import FEATURES, HOLES_SQL, load, query, r6, with_holes


@query(
    "fill_zero",
    f"WITH {HOLES_SQL} SELECT l_orderkey, coalesce(quantity, 0) AS quantity, price, coalesce(discount, 0) AS discount, coalesce(tax, 0) AS tax, label, segment FROM feats",
)
def fill_zero(spark, d):
    return P.fill_zero(with_holes(spark, d))


@query(
    "fill_median",
    f"""WITH {HOLES_SQL}, m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in FEATURES)} FROM feats)
        SELECT l_orderkey, {', '.join(f'round(coalesce(f.{c}, m.{c}), 6) AS {c}' for c in FEATURES)} FROM feats f CROSS JOIN m""",
)
def fill_median(spark, d):
    return P.fill_median(with_holes(spark, d), FEATURES).select("l_orderkey", *[r6(c).alias(c) for c in FEATURES])


@query(
    "fill_median_zero_missing",
    f"""WITH {HOLES_SQL}, m AS (SELECT {', '.join(f'quantile_cont(CASE WHEN {c} <> 0 THEN {c} END, 0.5) AS {c}' for c in FEATURES)} FROM feats)
        SELECT l_orderkey, {', '.join(f'round(coalesce(nullif(f.{c}, 0), m.{c}, 0), 6) AS {c}' for c in FEATURES)} FROM feats f CROSS JOIN m""",
)
def fill_median_zero_missing(spark, d):
    out = P.fill_median(with_holes(spark, d), FEATURES, missing=0, rest_zero=True)
    return out.select("l_orderkey", *[r6(c).alias(c) for c in FEATURES])


@query(
    "fill_most_frequent",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_totalprice > 90000 THEN 1 ELSE 0 END AS large FROM orders),
        p AS (SELECT o_orderpriority AS v FROM s WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        l AS (SELECT large AS v FROM s WHERE large IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM p)) AS o_orderpriority, coalesce(large, (SELECT v FROM l)) AS large FROM s""",
)
def fill_most_frequent(spark, d):
    key = F.col("o_orderkey")
    o = load(spark, d, "orders").select(
        "o_orderkey", F.when(key % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(key % 6 != 0, F.when(F.col("o_totalprice") > 90000, 1).otherwise(0)).alias("large"),
    )
    return P.fill_mode(o, ["o_orderpriority", "large"])


@query(
    "scale_minmax",
    f"""WITH {HOLES_SQL}, m AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in FEATURES)} FROM feats)
        SELECT l_orderkey, {', '.join(f'round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}' for c in FEATURES)} FROM feats CROSS JOIN m""",
)
def scale_minmax(spark, d):
    return P.scale_minmax(with_holes(spark, d), FEATURES).select("l_orderkey", *[r6(c).alias(c) for c in FEATURES])


@query(
    "scale_standard",
    f"""WITH {HOLES_SQL}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM feats)
        SELECT l_orderkey, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in FEATURES)} FROM feats CROSS JOIN m""",
)
def scale_standard(spark, d):
    return P.scale_standard(with_holes(spark, d), FEATURES).select("l_orderkey", *[r6(c).alias(c) for c in FEATURES])


@query("variance_filter", f"WITH {HOLES_SQL} SELECT l_orderkey, quantity, price, label, segment FROM feats")
def variance_filter(spark, d):
    return P.variance_filter(with_holes(spark, d), [*FEATURES, "label", "segment"], 0.16)


@query(
    "string_index",
    """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS i FROM part GROUP BY p_brand)
       SELECT p_partkey, CAST(i AS DOUBLE) AS p_brand_idx FROM part JOIN c USING (p_brand)""",
)
def string_index(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand")
    return P.index_strings(p, ["p_brand"]).transform(p).select("p_partkey", "p_brand_idx")


@query(
    "one_hot_priority",
    """SELECT o_orderkey, CASE WHEN level = 1 THEN 1 ELSE 0 END AS level_1, CASE WHEN level = 2 THEN 1 ELSE 0 END AS level_2,
       CASE WHEN level = 3 THEN 1 ELSE 0 END AS level_3, CASE WHEN level = 4 THEN 1 ELSE 0 END AS level_4, CASE WHEN level = 5 THEN 1 ELSE 0 END AS level_5
       FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level FROM orders)""",
)
def one_hot_priority(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return P.one_hot(o, "level").drop("level")


def _f_sql() -> str:
    one = "SELECT '{c}' AS feature, pow(corr({c}, label), 2) * (count({c}) - 2) / (1 - pow(corr({c}, label), 2)) AS f FROM feats"
    return f"WITH {HOLES_SQL} SELECT feature, round(f, 6) AS f FROM ({' UNION ALL '.join(one.format(c=c) for c in FEATURES)}) ORDER BY f DESC LIMIT 2"


@query("k_best_features", _f_sql())
def k_best_features(spark, d):
    return P.select_k_best(with_holes(spark, d), FEATURES, "label", 2).withColumn("f", r6("f"))


@query("assembled_features", f"WITH {HOLES_SQL} SELECT l_orderkey, round(coalesce(quantity, 0) + price, 4) AS total FROM feats")
def assembled_features(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return P.assemble(P.fill_zero(with_holes(spark, d)), ["quantity", "price"]).select("l_orderkey", F.round(v[0] + v[1], 4).alias("total"))


@query("recursive_elimination")
def recursive_elimination(spark, d):
    return P.recursive_elimination(P.scale_standard(P.fill_zero(with_holes(spark, d)), FEATURES), FEATURES, "label", 2)


def _vectors(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


VECTOR_COLS = [f"x{i}" for i in range(64)]


@query("pca_component_number")
def pca_component_number(spark, d):
    df = P.scale_minmax(_vectors(spark, d), VECTOR_COLS)
    k = P.pca_components(df, VECTOR_COLS, 0.98)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(k).alias("components"))


@query("pca_projection")
def pca_projection(spark, d):
    return P.pca_project(P.scale_minmax(_vectors(spark, d), VECTOR_COLS), VECTOR_COLS, 1, 4, "label")


@query("pca_loadings")
def pca_loadings(spark, d):
    return P.pca_loadings(P.scale_minmax(_vectors(spark, d), VECTOR_COLS), VECTOR_COLS, 3)


@query("wide_elimination")
def wide_elimination(spark, d):
    """Dimensions of the vectors that tell label 0 from the others, until ten are left."""
    df = _vectors(spark, d).withColumn("label", F.when(F.col("label") == 0, 1).otherwise(0))
    return P.recursive_elimination(df, VECTOR_COLS, "label", 10)
