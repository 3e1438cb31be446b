"""Flows and transfers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import transactions as TR
from riskfeat.plans.base import load, query
from riskfeat.plans.rows import SIGNED_SQL, offset_sql, signed_events


@query(
    "party_totals",
    """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders
       WHERE strftime(o_orderdate, '%Y-%m') = '1998-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
)
def party_totals(spark, d):
    active = load(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    # The month is a range on the stored column, so that it reaches the file scan.
    month = load(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-02-01").cast("timestamp")))
    out = TR.party_totals(month.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), active, "o_custkey", "o_totalprice")
    return out.withColumn("total", F.col("total").cast("double"))


def _orders(spark, d):
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("party"), F.date_format("o_orderdate", "yyyyMM").alias("month"), F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


ORDERS_SQL = "t AS (SELECT o_custkey AS party, strftime(o_orderdate, '%Y%m') AS month, o_orderpriority AS type, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"
KEYS = ["party", "month", "type"]


@query(
    "monthly_income",
    f"WITH {ORDERS_SQL} SELECT party, month, type, CAST(sum(amount) AS DOUBLE) AS sum_income, count(amount) AS count_income FROM t WHERE type IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3",
)
def monthly_income(spark, d):
    out = TR.monthly_flow(_orders(spark, d), KEYS, "type", "amount", "income", codes=["1-URGENT", "2-HIGH"])
    return out.withColumn("sum_income", F.col("sum_income").cast("double"))


@query(
    "monthly_cost",
    f"WITH {ORDERS_SQL} SELECT party, month, type, CAST(sum(amount) AS DOUBLE) AS sum_cost, count(amount) AS count_cost FROM t WHERE type NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3",
)
def monthly_cost(spark, d):
    out = TR.monthly_flow(_orders(spark, d), KEYS, "type", "amount", "cost", exclude=["1-URGENT", "2-HIGH"])
    return out.withColumn("sum_cost", F.col("sum_cost").cast("double"))


@query(
    "reversing_flow",
    f"WITH {ORDERS_SQL} SELECT party, month, type, CAST(sum(amount) AS DOUBLE) AS sum_cost_net, count(amount) AS count_cost_net FROM t WHERE type = '5-LOW' GROUP BY 1, 2, 3",
)
def reversing_flow(spark, d):
    out = TR.monthly_flow(_orders(spark, d), KEYS, "type", "amount", "cost_net", codes=["5-LOW"])
    return out.withColumn("sum_cost_net", F.col("sum_cost_net").cast("double"))


@query(
    "netted_type",
    f"WITH {ORDERS_SQL} SELECT party, month, CAST(sum(amount) AS DOUBLE) AS sum_net, count(amount) AS count_net, 'Net' AS type FROM t WHERE type IN ('3-MEDIUM', '5-LOW') GROUP BY 1, 2",
)
def netted_type(spark, d):
    out = TR.net_type(_orders(spark, d), ["party", "month"], "type", "amount", ["3-MEDIUM", "5-LOW"], "Net", "net")
    return out.withColumn("sum_net", F.col("sum_net").cast("double"))


@query(
    "daily_totals",
    """SELECT strftime(d, '%Y-%m-%d') AS date, n, CAST(floor(s / n) AS BIGINT) AS avg_amount, CAST(floor(s) AS BIGINT) AS sum_amount FROM (
         SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY 1)""",
)
def daily_totals(spark, d):
    o = load(spark, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    out = TR.daily_totals(o, "o_orderdate", "amount")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "n", F.col("avg_amount").cast("bigint"), F.col("sum_amount").cast("bigint"))


@query(
    "transfer_flags",
    """SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN 1 ELSE 0 END AS to_self, CASE WHEN a <> b THEN 1 ELSE 0 END AS to_other
       FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 10 AS a, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 10 END AS b FROM lineitem)""",
)
def transfer_flags(spark, d):
    li = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("a"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 10).alias("b")
    )
    return TR.transfer_flags(li, "a", "b").drop("a", "b")


@query(
    "residual_flow",
    f"""WITH {SIGNED_SQL}, p1 AS ({offset_sql('signed', 'day, event_type', 'day, event_type, abs(amount), amount, event_id')}),
        r AS (SELECT event_id, user_id, event_type, day, amount FROM p1 WHERE sum_check = 0 AND event_type <> 'error'),
        p2 AS ({offset_sql('r', 'day', 'day, abs(amount), amount DESC, event_id')})
        SELECT user_id, strftime(day, '%Y%m') AS month, event_type, sum(amount) AS sum_income, count(amount) AS count_income FROM p2
        WHERE sum_check = 0 AND event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3""",
)
def residual_flow(spark, d):
    e = signed_events(spark, d).withColumn("month", F.date_format("day", "yyyyMM"))
    return TR.residual_flow(e, "user_id", "day", "month", "event_type", "amount", "event_id", "error", ["click", "view", "purchase"])


@query("payment_days", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%-d') AS day FROM orders")
def payment_days(spark, d):
    return TR.payment_day(load(spark, d, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"]).drop("o_orderdate")


@query(
    "same_product",
    """SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN nation ON l_partkey % 25 = n_nationkey WHERE l_suppkey % 25 = l_partkey % 25""",
)
def same_product(spark, d):
    li = load(spark, d, "lineitem").withColumns({"product": F.col("l_suppkey") % 25, "sec_product": F.col("l_partkey") % 25})
    products = load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("sec_product"), "n_name")
    return TR.same_product(li, products, "product", "sec_product").select("l_orderkey", "l_linenumber", "n_name")


def _trade(spark, d):
    """Customer nation, supplier nation and return flag per line item."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), F.col("l_returnflag").alias("relation"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )


TRADE_SQL = """trade AS (SELECT c_nationkey AS a, s_nationkey AS b, l_returnflag AS relation, CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query("undirected_edges", f"WITH {TRADE_SQL} SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM trade GROUP BY 1, 2")
def undirected_edges(spark, d):
    return TR.edges(_trade(spark, d), "a", "b", "undirected")


@query("directed_edges", f"WITH {TRADE_SQL} SELECT a AS src, b AS dst, CAST(sum(quantity) AS BIGINT) AS weight FROM trade GROUP BY 1, 2")
def directed_edges(spark, d):
    return TR.edge_attributes(TR.edges(_trade(spark, d), "a", "b", "directed", weight=F.col("quantity")), ["weight"])


@query("multi_edges", f"WITH {TRADE_SQL} SELECT a AS src, b AS dst, relation, count(*) AS weight FROM trade GROUP BY 1, 2, 3")
def multi_edges(spark, d):
    return TR.edges(_trade(spark, d), "a", "b", "multi", relation="relation")


@query("edge_lookup", f"WITH {TRADE_SQL} SELECT a AS src, b AS dst, count(*) AS weight FROM trade WHERE (a = 3 AND b = 7) OR (a = 7 AND b = 3) GROUP BY 1, 2")
def edge_lookup(spark, d):
    return TR.edge_between(TR.edges(_trade(spark, d), "a", "b"), 3, 7, directed=False)


