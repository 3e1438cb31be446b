"""Counts, statistics and profiles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import profile as P
from riskfeat.operators import stats as S
from riskfeat.plans.base import FEATURES, HOLES_SQL, load, money, money_sql, query, r6, with_holes


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count(spark, d):
    return S.group_count(load(spark, d, "events"), ["event_type"])


@query("global_aggregate", f"SELECT count(*) AS n, {money_sql('o_totalprice')} AS total, max(o_totalprice) AS highest FROM orders")
def global_aggregate(spark, d):
    return load(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"), F.max("o_totalprice").alias("highest"))


@query(
    "aggregate_by_key",
    f"""SELECT o_custkey, {money_sql('o_totalprice')} AS total, {money_sql('o_totalprice')} / count(*) AS average, min(o_totalprice) AS lowest,
        max(o_totalprice) AS highest, count(o_orderkey) AS n FROM orders GROUP BY o_custkey""",
)
def aggregate_by_key(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(
        money("o_totalprice").alias("total"), (money("o_totalprice") / F.count(F.lit(1))).alias("average"), F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"), F.count("o_orderkey").alias("n"),
    )


@query(
    "aggregates_by_name",
    "SELECT count(*) AS n, round(avg(p_size), 6) AS avg_size, round(avg(p_retailprice), 6) AS avg_price, max(p_size) AS max_size FROM part",
)
def aggregates_by_name(spark, d):
    named = load(spark, d, "part").agg({"*": "count", "p_size": "avg", "p_retailprice": "avg"})
    top = load(spark, d, "part").agg(F.max("p_size").alias("m")).scalar()
    return named.select(
        F.col("count(1)").alias("n"), r6("avg(p_size)").alias("avg_size"), r6("avg(p_retailprice)").alias("avg_price"), top.alias("max_size")
    )


@query(
    "sign_flipped_sums",
    f"SELECT l_suppkey, l_returnflag, count(*) AS n, {money_sql('-l_extendedprice')} AS volume FROM lineitem GROUP BY l_suppkey, l_returnflag",
)
def sign_flipped_sums(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), money(-F.col("l_extendedprice")).alias("volume")
    )


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, d):
    return load(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("distinct_counts", "SELECT count(DISTINCT o_custkey) AS parties, count(DISTINCT o_orderstatus) AS states FROM orders")
def distinct_counts(spark, d):
    return load(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("parties"), F.count_distinct("o_orderstatus").alias("states"))


@query("drop_duplicate_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def drop_duplicate_rows(spark, d):
    return load(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


@query(
    "first_value_per_group",
    "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey",
)
def first_value_per_group(spark, d):
    first = F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return load(spark, d, "orders").groupBy("o_custkey").agg(first.alias("first_order"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _pivot_sql() -> str:
    cells = ", ".join(
        f"CAST(sum(CASE WHEN event_type = '{t}' AND value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS {t}_n_in, "
        f"CAST(sum(CASE WHEN event_type = '{t}' AND value < 10 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS {t}_amt_out"
        for t in EVENT_TYPES
    )
    return f"SELECT user_id, {cells} FROM events GROUP BY user_id"


@query("pivot_flows", _pivot_sql())
def pivot_flows(spark, d):
    large = F.col("value") >= 10
    out = S.pivot_sums(
        load(spark, d, "events"), ["user_id"], "event_type", EVENT_TYPES,
        {
            "n_in": F.sum(F.when(large, 1).otherwise(0)),
            "amt_out": F.sum(F.when(~large, F.col("value").cast("decimal(18,2)")).otherwise(0)).cast("double"),
        },
    )
    # A type a user never had counts as 0.
    return out.na.fill(0)


@query(
    "spread_list",
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS item0, string_split(p_name, ' ')[2] AS item1, string_split(p_name, ' ')[3] AS item2 FROM part",
)
def spread_list(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return S.spread_list(p, ["p_partkey"], "w", 3)


@query(
    "crosstab",
    """SELECT o_orderpriority AS o_orderpriority_o_orderstatus, count(*) FILTER (o_orderstatus = 'F') AS "F",
              count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def crosstab(spark, d):
    return S.crosstab(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "frequent_items",
    "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity HAVING count(*) > 0.02 * (SELECT count(*) FROM lineitem)",
)
def frequent_items(spark, d):
    return S.frequent_items(load(spark, d, "lineitem"), "l_quantity", 0.02)


@query("covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS covar FROM lineitem")
def covariance(spark, d):
    return S.covar(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("covar", 2).alias("covar"))


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def correlation(spark, d):
    return S.corr(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r6("corr").alias("corr"))


def _matrix_sql() -> str:
    rows = [
        f"SELECT '{a}' AS feature, " + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in FEATURES) + " FROM feats"
        for a in FEATURES
    ]
    return f"WITH {HOLES_SQL} " + " UNION ALL ".join(rows)


@query("correlation_matrix", _matrix_sql())
def correlation_matrix(spark, d):
    m = S.corr_matrix(with_holes(spark, d), FEATURES)
    return m.select("feature", *[r6(c).alias(c) for c in FEATURES])


def _pairs_sql(limit: float) -> str:
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS c FROM feats" for a, b in pairs)
    return f"WITH {HOLES_SQL} SELECT feature_1, feature_2, round(c, 6) AS correlation FROM ({body}) WHERE c > {limit}"


@query("top_correlations", _pairs_sql(0.001))
def top_correlations(spark, d):
    return S.top_abs_correlations(with_holes(spark, d), FEATURES, 0.001).withColumn("correlation", r6("correlation"))


@query(
    "wide_correlations",
    """WITH f AS (SELECT doc_id, unnest(range(24)) AS i, length(text) AS n FROM documents), v AS (SELECT doc_id, i, CAST((n * (i + 3)) % (17 + i) AS DOUBLE) AS x FROM f)
       SELECT 'v' || a.i AS feature_1, 'v' || b.i AS feature_2, round(corr(a.x, b.x), 6) AS correlation FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.i < b.i
       GROUP BY a.i, b.i HAVING var_pop(a.x) > 0 AND var_pop(b.x) > 0""",
)
def wide_correlations(spark, d):
    n = F.length("text")
    cols = {f"v{i}": ((n * (i + 3)) % (17 + i)).cast("double") for i in range(24)}
    df = load(spark, d, "documents").select(*[c.alias(k) for k, c in cols.items()])
    return S.correlations(df, list(cols)).where(F.col("correlation").isNotNull()).withColumn("correlation", r6("correlation"))


def _describe_sql() -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM feats"
    return f"WITH {HOLES_SQL} " + " UNION ALL ".join(one.format(c=c) for c in ["quantity", "discount", "tax"])


@query("describe", _describe_sql())
def describe(spark, d):
    out = S.describe(with_holes(spark, d), ["quantity", "discount", "tax"])
    return out.withColumns({"mean": r6("mean"), "stddev": F.round("stddev", 4)})


@query(
    "quantiles",
    " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS value FROM lineitem" for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)),
)
def quantiles(spark, d):
    out = S.quantiles(load(spark, d, "lineitem"), "l_extendedprice", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    return out.withColumn("value", r6("value"))


@query(
    "histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), w AS (SELECT unnest(range(1, 12)) AS bucket)
       SELECT CAST(w.bucket AS INTEGER) AS bucket, round(lo + (w.bucket - 1) * ((hi - lo) / 11), 4) AS lo,
              round(CASE WHEN w.bucket = 11 THEN hi ELSE lo + w.bucket * ((hi - lo) / 11) END, 4) AS hi, coalesce(c.n, 0) AS n
       FROM w CROSS JOIN b LEFT JOIN (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 11) AS INTEGER) + 1, 11) AS bucket, count(*) AS n
         FROM orders, b GROUP BY 1) c ON w.bucket = c.bucket""",
)
def histogram(spark, d):
    return S.histogram(load(spark, d, "orders"), "o_totalprice", 11).withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


BANDS = [60.0, 1000.0]
BAND_SQL = "CASE WHEN v <= 60 THEN 0 WHEN v <= 1000 THEN 1 ELSE 2 END"


@query(
    "banded_histogram",
    f"""WITH v AS (SELECT o_totalprice / 200 AS v FROM orders), k AS (SELECT v, {BAND_SQL} AS band FROM v WHERE v > 0 AND v < 150000),
        b AS (SELECT band, min(v) AS lo, max(v) AS hi FROM k GROUP BY band)
        SELECT CAST(k.band AS INTEGER) AS band, least(CAST(floor((v - lo) / (hi - lo) * 11) AS INTEGER) + 1, 11) AS bucket, count(*) AS n
        FROM k JOIN b USING (band) GROUP BY 1, 2""",
)
def banded_histogram(spark, d):
    v = load(spark, d, "orders").select((F.col("o_totalprice") / 200).alias("v"))
    return S.banded_histogram(v, "v", BANDS, 11, above=0, below=150000)


@query("band_counts", f"SELECT CAST({BAND_SQL} AS INTEGER) AS band, count(*) AS n FROM (SELECT o_totalprice / 200 AS v FROM orders) GROUP BY 1")
def band_counts(spark, d):
    return S.band_counts(load(spark, d, "orders").select((F.col("o_totalprice") / 200).alias("v")), "v", BANDS)


@query(
    "share_of_total",
    f"""SELECT event_type, {money_sql('value')} AS total, round(100 * {money_sql('value')} / (SELECT {money_sql('value')} FROM events), 6) AS pct
        FROM events GROUP BY event_type""",
)
def share_of_total(spark, d):
    e = load(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = S.share_of_total(e, ["event_type"], "value")
    whole = F.col("total").cast("double")
    return out.select("event_type", whole.alias("total"), F.round(F.col("pct").cast("double"), 6).alias("pct"))


@query("count_by_weekday", "SELECT strftime(o_orderdate, '%a') AS weekday, count(*) AS n FROM orders GROUP BY 1")
def count_by_weekday(spark, d):
    return S.group_by_date(load(spark, d, "orders"), "o_orderdate", "weekday")


@query("mean_by_group", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def mean_by_group(spark, d):
    return S.group_mean(load(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("mean", F.round("mean", 4))


@query(
    "type_summary",
    f"SELECT l_returnflag, l_linestatus, count(*) AS n, {money_sql('l_extendedprice')} AS amount FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def type_summary(spark, d):
    li = load(spark, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    return S.type_summary(li, ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumn("amount", F.col("amount").cast("double"))


@query(
    "numeric_feature_means",
    f"WITH {HOLES_SQL} SELECT round(avg(quantity), 6) AS quantity, round(avg(price), 4) AS price, round(avg(discount), 6) AS discount FROM feats",
)
def numeric_feature_means(spark, d):
    df = with_holes(spark, d)
    chosen = S.numeric_features(df, [*FEATURES, "label", "segment"], 10)
    return df.agg(*[F.round(F.avg(c), 4 if c == "price" else 6).alias(c) for c in chosen])


@query(
    "binary_feature_shares",
    f"WITH {HOLES_SQL} SELECT round(avg(label), 6) AS label, round(avg(segment), 6) AS segment FROM feats",
)
def binary_feature_shares(spark, d):
    df = with_holes(spark, d)
    return df.agg(*[r6(F.avg(c)).alias(c) for c in S.binary_features(df, [*FEATURES, "label", "segment"])])


# --- profiles ---------------------------------------------------------------------------------


def _overview_sql() -> str:
    types = {"l_orderkey": "bigint", **{c: "double" for c in FEATURES}, "label": "int", "segment": "int"}
    return f"WITH {HOLES_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_missing FROM feats" for c, t in types.items()
    )


@query("column_overview", _overview_sql())
def column_overview(spark, d):
    return P.overview(with_holes(spark, d)).withColumn("pct_missing", r6("pct_missing"))


@query("drop_sparse_columns", f"WITH {HOLES_SQL} SELECT l_orderkey, price, tax, label, segment FROM feats")
def drop_sparse_columns(spark, d):
    return P.drop_sparse(with_holes(spark, d), 10.0)


@query(
    "empty_tables",
    """SELECT 'nation' AS table_name, count(*) = 0 AS is_empty FROM nation UNION ALL SELECT 'orders', count(*) = 0 FROM orders
       UNION ALL SELECT 'cheap_orders', count(*) = 0 FROM orders WHERE o_totalprice < 0""",
)
def empty_tables(spark, d):
    o = load(spark, d, "orders")
    return P.split_empty({"nation": load(spark, d, "nation"), "orders": o, "cheap_orders": o.where(F.col("o_totalprice") < 0)})


STATUS_SOURCE = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_totalprice < 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}"
STATUS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _status_frame(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("status_orders")
    return spark.sql(STATUS_SOURCE.format(orders="status_orders"))


@query(
    "population_status",
    f"WITH s AS ({STATUS_SOURCE.format(orders='orders')}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = count(*) THEN 'fully populated' WHEN count({c}) > 0 THEN 'partly populated' ELSE 'empty' END AS status FROM s"
        for c in STATUS_COLS
    ),
)
def population_status(spark, d):
    return P.population_status(_status_frame(spark, d))


def _report_sql() -> str:
    parts = []
    for c in STATUS_COLS[1:]:
        zero = f"count(*) FILTER ({c} = 0)" if c in ("o_custkey", "o_totalprice") else "0"
        numeric = c in ("o_custkey", "o_totalprice")
        miss, zer = f"printf('%.4f', (count(*) - count({c})) / count(*)::DOUBLE)", f"printf('%.4f', ({zero}) / count(*)::DOUBLE)"
        partly = f"CASE WHEN {zero} = 0 THEN {miss} || ' missing and no zero' ELSE {miss} || ' missing and ' || {zer} || ' zero' END" if numeric else f"{miss} || ' missing'"
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = count(*) AND {zero} = 0 THEN '100% populated' WHEN count({c}) = count(*) THEN {zer} || ' values are 0' "
            f"WHEN count({c}) > 0 THEN {partly} ELSE '0% populated' END AS status FROM s"
        )
    return f"WITH s AS ({STATUS_SOURCE.format(orders='orders')}) " + " UNION ALL ".join(parts)


@query("population_report", _report_sql())
def population_report(spark, d):
    return P.population_report(_status_frame(spark, d), ["o_orderkey"])


@query(
    "null_count_distribution",
    f"""WITH s AS ({STATUS_SOURCE.format(orders='orders')}) SELECT CAST({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in STATUS_COLS)} AS INTEGER) AS n_nulls,
        count(*) AS n FROM s GROUP BY 1""",
)
def null_count_distribution(spark, d):
    return P.null_count_distribution(_status_frame(spark, d))


@query(
    "feature_profile",
    f"WITH {HOLES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing, round(count(*) FILTER ({c} = 0) / count(*)::DOUBLE, 6) AS zero, count(DISTINCT {c}) AS n_unique FROM feats"
        for c in FEATURES
    ),
)
def feature_profile(spark, d):
    return S.feature_profile(with_holes(spark, d), FEATURES).withColumns({"missing": r6("missing"), "zero": r6("zero")})


@query(
    "label_distribution",
    f"""WITH {HOLES_SQL} SELECT label, count(*) AS n, (SELECT count(*) FROM feats) AS n_rows, CAST(7 AS INTEGER) AS n_columns FROM feats GROUP BY label""",
)
def label_distribution(spark, d):
    return P.basic_stats(with_holes(spark, d), "label")


@query("rows_per_partition")
def rows_per_partition(spark, d):
    return P.partition_counts(load(spark, d, "lineitem").repartition(8, "l_orderkey"))


