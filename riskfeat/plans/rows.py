"""Windows, sorts, limits, unions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import rows as R
from riskfeat.plans.base import load, query


@query(
    "top_values_per_group",
    """SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS INTEGER) AS rank
       FROM lineitem) WHERE rank <= 2""",
)
def top_values_per_group(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return R.top_k_dense(li, ["l_suppkey"], "l_quantity", 2)


@query("row_number_per_group", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders")
def row_number_per_group(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.number_rows(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], "rn").select("o_orderkey", "rn")


@query(
    "previous_and_next",
    """SELECT event_id, lag(value) OVER w AS prev_value, lag(event_type) OVER w AS prev_type, lead(value) OVER w AS next_value
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def previous_and_next(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    n = R.with_neighbours(e, ["user_id"], ["ts", "event_id"], ["value", "event_type"])
    return n.select("event_id", F.col("prev.value").alias("prev_value"), F.col("prev.event_type").alias("prev_type"), F.col("next.value").alias("next_value"))


SIGNED_SQL = "signed AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * floor(value / 10) AS amount FROM events)"


def signed_events(spark, d):
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return load(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day"), (sign * F.floor(F.col("value") / 10)).cast("double").alias("amount")
    )


def offset_sql(source: str, keys: str, order: str) -> str:
    """Neighbour test in the party's full order, the way a plain window states it."""
    w = f"(PARTITION BY user_id ORDER BY {order})"
    same_prev = " AND ".join(f"{k} = lag({k}) OVER {w}" for k in keys.split(", "))
    same_next = " AND ".join(f"{k} = lead({k}) OVER {w}" for k in keys.split(", "))
    return (
        f"SELECT *, CASE WHEN amount + lag(amount) OVER {w} = 0 AND {same_prev} THEN 1 ELSE 0 END"
        f" + CASE WHEN amount + lead(amount) OVER {w} = 0 AND {same_next} THEN 1 ELSE 0 END AS sum_check FROM {source}"
    )


@query(
    "offset_pairs",
    f"WITH {SIGNED_SQL}, p AS ({offset_sql('signed', 'day, event_type', 'day, event_type, abs(amount), amount, event_id')}) SELECT event_id, CAST(sum_check AS INTEGER) AS sum_check FROM p",
)
def offset_pairs(spark, d):
    return R.offset_pairs(signed_events(spark, d), "user_id", "day", "amount", "event_type", "event_id").select("event_id", "sum_check")


@query(
    "running_word_lists",
    """SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS pos, w[pos] AS word, array_to_string(w[1:pos], ' ') AS so_far FROM (
         SELECT p_partkey, list_sort(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)""",
)
def running_word_lists(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return R.running_list(p, "w", ["p_partkey"]).withColumn("so_far", F.array_join("so_far", " "))


@query(
    "best_row_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def best_row_per_key(spark, d):
    best = R.first_per_key(load(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("global_sort", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def global_sort(spark, d):
    return R.sort_rows(load(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"])


@query("sort_within_partitions", "SELECT user_id, event_id FROM events")
def sort_within_partitions(spark, d):
    return R.sort_rows(load(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id", "ts"], within_partitions=True).drop("ts")


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("top_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_by_score(spark, d):
    return R.top_n(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("sort_by_expression", "SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier ORDER BY abs(s_acctbal), s_suppkey")
def sort_by_expression(spark, d):
    return R.sort_rows(load(spark, d, "supplier"), [F.abs("s_acctbal"), "s_suppkey"]).select("s_suppkey", F.abs("s_acctbal").alias("size"))


@query("sort_by_list", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ' ') AS words FROM part ORDER BY string_split(p_name, ' '), p_partkey")
def sort_by_list(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w")).sort("w", "p_partkey")
    return p.select("p_partkey", F.array_join("w", " ").alias("words"))


@query(
    "union_tagged",
    "SELECT c_custkey AS id, c_acctbal AS balance, 'train' AS data FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'test' FROM supplier",
)
def union_tagged(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return R.union_tagged({"train": c, "test": s}, "data")


@query(
    "union_many",
    "SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation",
)
def union_many(spark, d):
    part = lambda t, c: load(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("nation"))
    return R.union_all(part("customer", "c_nationkey"), part("supplier", "s_nationkey"), part("nation", "n_nationkey"))
