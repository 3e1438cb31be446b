"""Joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import joins as J
from riskfeat.operators import transactions as TR
from riskfeat.plans.base import load, money, money_sql, query


@query(
    "inner_join",
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def inner_join(spark, d):
    o = load(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return o.join(load(spark, d, "customer"), ["c_custkey"], "inner").select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "inner_join_named_keys",
    f"""SELECT l_orderkey, o_orderpriority, {money_sql('l_extendedprice')} AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, o_orderpriority""",
)
def inner_join_named_keys(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", "o_orderpriority").agg(money("l_extendedprice").alias("amount"))


@query(
    "left_join",
    "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey",
)
def left_join(spark, d):
    big = load(spark, d, "orders").where(F.col("o_totalprice") > 400000).withColumnRenamed("o_custkey", "c_custkey")
    return load(spark, d, "customer").join(big, ["c_custkey"], "left").select("c_custkey", "c_name", "o_orderkey")


@query(
    "chain_left_join",
    """SELECT l.l_orderkey AS orderkey, l.l_suppkey AS suppkey, l.n AS n_lines, o.total AS order_total, p.shipped AS shipped FROM
         (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) l
         LEFT JOIN (SELECT l_orderkey, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) o USING (l_orderkey, l_suppkey)
         LEFT JOIN (SELECT l_orderkey, l_suppkey, strftime(max(l_shipdate), '%Y-%m-%d') AS shipped FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) p USING (l_orderkey, l_suppkey)""",
)
def chain_left_join(spark, d):
    li = load(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "orderkey", "l_suppkey": "suppkey"})
    keys = ["orderkey", "suppkey"]
    counts = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    totals = li.where(F.col("l_returnflag") == "R").groupBy(*keys).agg(money("l_extendedprice").alias("order_total"))
    last = li.where(F.col("l_linestatus") == "F").groupBy(*keys).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("shipped"))
    return J.chain_left_join([counts, totals, last], keys)


@query(
    "trimmed_key_join",
    "SELECT o_orderkey, r_regionkey FROM orders JOIN region ON substr(o_orderpriority, 1, 1) = CAST(r_regionkey + 1 AS VARCHAR)",
)
def trimmed_key_join(spark, d):
    o = load(spark, d, "orders").withColumn("code", F.rpad(F.substring("o_orderpriority", 1, 1), 8, " "))
    r = load(spark, d, "region").withColumn("class_code", F.lpad((F.col("r_regionkey") + 1).cast("string"), 5, " "))
    return J.join_trimmed(o, r, "code", "class_code").select("o_orderkey", "r_regionkey")


@query(
    "restrict_to_parties",
    "SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)",
)
def restrict_to_parties(spark, d):
    o = load(spark, d, "orders")
    qualifying = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
    return J.restrict_to(o, qualifying, ["o_custkey"]).select(*[c for c in o.columns if c != "o_orderdate"])


@query(
    "encoded_key_join",
    """SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON base64(encode(CAST(o_custkey AS VARCHAR))) = base64(encode(CAST(c_custkey AS VARCHAR)))
       AND (o_orderkey % 3) = (c_custkey % 3)""",
)
def encoded_key_join(spark, d):
    o = load(spark, d, "orders").withColumn("id", F.base64(F.col("o_custkey").cast("string").cast("binary"))).withColumn("m", F.col("o_orderkey") % 3)
    c = load(spark, d, "customer").withColumn("bin_id", F.col("c_custkey").cast("string").cast("binary"))
    c = c.select(F.base64("bin_id").alias("id"), (F.col("c_custkey") % 3).alias("m"), "c_mktsegment")
    return o.join(c, ["id", "m"], "left").select("o_orderkey", "c_mktsegment")


def _links(spark, d):
    """Agreement roles from line items: the supplier holds the order's agreement, the part's number is a co-holder."""
    li = load(spark, d, "lineitem")
    holder = li.select(F.col("l_orderkey").alias("agreement"), F.col("l_suppkey").alias("party"), F.lit("00").alias("role"))
    co = li.select(F.col("l_orderkey").alias("agreement"), (F.col("l_partkey") % 100).alias("party"), F.lit("01").alias("role"))
    return holder.unionByName(co).distinct()


LINKS_SQL = """links AS MATERIALIZED (SELECT DISTINCT agreement, party, role FROM (
  SELECT l_orderkey AS agreement, l_suppkey AS party, '00' AS role FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey % 100, '01' FROM lineitem))"""


def _transfers(spark, d):
    """Transfers from orders: between the customer's order and the order after it."""
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("agreement"), (F.col("o_orderkey") + 1).alias("sec_agreement"),
        (F.col("o_custkey") % 100).alias("party"), (F.col("o_custkey") % 90).alias("sec_party"), F.col("o_orderpriority").alias("type"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).alias("sec_account_type"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("y")).alias("sec_clearing"), F.lit(None).cast("string").alias("sec_account"),
    )


TRANSFERS_SQL = """transfers AS MATERIALIZED (SELECT o_orderkey AS id, o_orderkey AS agreement, o_orderkey + 1 AS sec_agreement, o_custkey % 100 AS party,
  o_custkey % 90 AS sec_party, o_orderpriority AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS sec_account_type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'y' END AS sec_clearing, CAST(NULL AS VARCHAR) AS sec_account FROM orders)"""
ROLES_SQL = """one_role AS MATERIALIZED (SELECT agreement, party, min(role) AS role FROM links GROUP BY agreement, party),
roles AS MATERIALIZED (SELECT t.*, b.role AS sec_role_on_main, c.role AS main_role_on_sec FROM transfers t
  LEFT JOIN one_role b ON t.agreement = b.agreement AND t.sec_party = b.party
  LEFT JOIN one_role c ON t.sec_agreement = c.agreement AND t.party = c.party)"""


@query(
    "role_lookups",
    f"WITH {LINKS_SQL}, {TRANSFERS_SQL}, {ROLES_SQL} SELECT id, party, sec_party, sec_role_on_main, main_role_on_sec FROM roles",
)
def role_lookups(spark, d):
    return J.attach_roles(_transfers(spark, d), _links(spark, d)).select("id", "party", "sec_party", "sec_role_on_main", "main_role_on_sec")


@query(
    "own_transfer_flags",
    f"""WITH {LINKS_SQL}, {TRANSFERS_SQL}, {ROLES_SQL}, flagged AS (SELECT *,
          sec_account_type IS NULL AND sec_clearing IS NULL AND sec_account IS NULL AND sec_agreement IS NOT NULL
          AND (sec_role_on_main IS NOT NULL OR main_role_on_sec IS NOT NULL) AS own FROM roles)
        SELECT id, party, type, sec_role_on_main, main_role_on_sec FROM flagged
        WHERE type <> '1-URGENT' AND NOT (type IN ('2-HIGH', '3-MEDIUM') AND own)""",
)
def own_transfer_flags(spark, d):
    kept = TR.own_transfer_flags(_transfers(spark, d), _links(spark, d), "1-URGENT", ["2-HIGH", "3-MEDIUM"])
    return kept.select("id", "party", "type", "sec_role_on_main", "main_role_on_sec")


@query(
    "holder_pairs",
    f"""WITH {LINKS_SQL}, holder AS MATERIALIZED (SELECT agreement, party FROM links WHERE role = '00'),
        co_holder AS MATERIALIZED (SELECT agreement, party FROM links WHERE role = '01')
        SELECT a.agreement, a.party, b.party AS party_sec FROM holder a JOIN co_holder b ON a.agreement = b.agreement""",
)
def holder_pairs(spark, d):
    return J.pair_roles(_links(spark, d))


@query(
    "households",
    f"""WITH {LINKS_SQL}, active AS MATERIALIZED (SELECT s_suppkey AS party FROM supplier WHERE s_acctbal > 0),
        holder AS MATERIALIZED (SELECT l.agreement, l.party FROM links l JOIN active USING (party) WHERE l.role = '00'),
        co_holder AS MATERIALIZED (SELECT agreement, party FROM links WHERE role = '01'),
        pairs AS MATERIALIZED (SELECT a.agreement, a.party, b.party AS party_sec FROM holder a JOIN co_holder b ON a.agreement = b.agreement),
        product_of AS MATERIALIZED (SELECT agreement, party, party % 25 AS product FROM links WHERE role = '00')
        SELECT p.agreement, p.party, p.party_sec, n.n_name AS productname FROM pairs p JOIN product_of q USING (agreement, party)
        LEFT JOIN nation n ON q.product = n.n_nationkey""",
)
def households(spark, d):
    links = _links(spark, d).withColumn("product", F.col("party") % 25)
    party = load(spark, d, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("party"))
    product = load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("product"), F.col("n_name").alias("productname"))
    return J.household(links, party, product).select("agreement", "party", "party_sec", "productname")


@query(
    "anti_join",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def anti_join(spark, d):
    done = load(spark, d, "orders").where(F.col("o_orderstatus") == "F").withColumnRenamed("o_custkey", "c_custkey")
    return J.without_rows_of(load(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey")


@query(
    "lookup_join",
    "SELECT c_custkey, n_name, CAST(c_acctbal AS DECIMAL(16,2))::DOUBLE AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def lookup_join(spark, d):
    n = load(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    out = J.lookup_join(load(spark, d, "customer"), n, ["c_nationkey"])
    return out.select("c_custkey", "n_name", F.col("c_acctbal").cast("decimal(16,2)").cast("double").alias("balance"))


@query(
    "lookback_events",
    """SELECT a.o_orderkey, b.o_orderkey AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
       AND b.o_orderdate >= a.o_orderdate - INTERVAL 6 MONTH AND b.o_orderdate < a.o_orderdate""",
)
def lookback_events(spark, d):
    o = load(spark, d, "orders")
    anchor = o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("anchor_date"))
    events = o.select(F.col("o_orderkey").alias("earlier"), "o_custkey", F.to_date("o_orderdate").alias("event_date"))
    return J.lookback_join(anchor, events, "o_custkey", "anchor_date", "event_date", 6).select("o_orderkey", "earlier")


@query(
    "lookback_features",
    """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mon, o_totalprice AS x FROM orders),
       a AS (SELECT DISTINCT o_custkey, mon AS anchor FROM m)
       SELECT a.o_custkey, strftime(a.anchor, '%Y-%m') AS month, count(m.x) AS n, round(sum(m.x), 2) AS total, round(sum(m.x), 2) / count(m.x) AS average,
              round(stddev_samp(m.x), 2) AS deviation, CASE WHEN count(m.x) > 0 THEN 1 ELSE 0 END AS flag
       FROM a LEFT JOIN m ON a.o_custkey = m.o_custkey AND m.mon >= a.anchor - INTERVAL 6 MONTH AND m.mon < a.anchor GROUP BY a.o_custkey, a.anchor""",
)
def lookback_features(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    anchor = o.select("o_custkey", F.trunc("o_orderdate", "month").alias("anchor")).distinct()
    f = TR.lookback_features(anchor, o, "o_custkey", "anchor", "o_orderdate", "o_totalprice", 6)
    return f.select(
        "o_custkey", F.date_format("anchor", "yyyy-MM").alias("month"), "n", F.round("sum", 2).alias("total"),
        F.try_divide(F.round("sum", 2), F.col("n")).alias("average"), F.round("std", 2).alias("deviation"), "flag",
    )


@query(
    "aggregate_join_back",
    """SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS party_total
       FROM orders""",
)
def aggregate_join_back(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.aggregate_join_back(o, ["o_custkey"], {"party_total": money("o_totalprice")}).drop("o_totalprice")


@query(
    "merge_aggregates",
    f"""SELECT * FROM (SELECT l_suppkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        JOIN (SELECT l_suppkey, {money_sql('l_extendedprice')} AS open_amount FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) USING (l_suppkey)""",
)
def merge_aggregates(spark, d):
    li = load(spark, d, "lineitem")
    returned = li.where(F.col("l_returnflag") == "R").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_returned"))
    still_open = li.where(F.col("l_linestatus") == "O").groupBy("l_suppkey").agg(money("l_extendedprice").alias("open_amount"))
    return J.merge_aggregates(returned, still_open, on=["l_suppkey"])


@query(
    "value_range_lookup",
    """SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -1000 AND 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low'
         WHEN c_acctbal BETWEEN 500 AND 5000 THEN 'middle' WHEN c_acctbal BETWEEN 7000 AND 9000 THEN 'high' END AS band FROM customer""",
)
def value_range_lookup(spark, d):
    ranges = [(-1000, 0, "debt"), (0, 1000, "low"), (500, 5000, "middle"), (7000, 9000, "high")]
    return J.range_class(load(spark, d, "customer"), F.col("c_acctbal"), ranges, "band").select("c_custkey", "band")


@query(
    "price_range_table",
    """WITH r AS (SELECT p_partkey AS priority, p_brand AS name, (p_retailprice - 10) * p_size AS lo, (p_retailprice + 10) * p_size AS hi FROM part),
       v AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem),
       hit AS (SELECT v, arg_min(name, priority) AS brand FROM v JOIN r ON v >= lo AND v <= hi GROUP BY v)
       SELECT l_orderkey, l_linenumber, l_extendedprice, brand FROM lineitem LEFT JOIN hit ON v = l_extendedprice""",
)
def price_range_table(spark, d):
    """Brand of the first part of which ``p_size`` pieces, 10 more or less each, cost as much as a line."""
    ranges = load(spark, d, "part").selectExpr(
        "(p_retailprice - 10) * p_size AS lo", "(p_retailprice + 10) * p_size AS hi", "p_partkey AS priority", "p_brand AS name"
    )
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return J.range_table_class(lines, F.col("l_extendedprice"), ranges, "brand")


def _counterparty_sql() -> str:
    from riskfeat.functions.fixed_values import CLEARING_RANGES, OTHER_COUNTERPARTY

    branches = " ".join(
        f"WHEN {'whole' if form == 'full' else 'head'} BETWEEN {lo} AND {hi} THEN '{name}'" for form, lo, hi, name in CLEARING_RANGES
    )
    return f"""SELECT counterparty, count(*) AS n FROM (SELECT CASE {branches} ELSE '{OTHER_COUNTERPARTY}' END AS counterparty FROM (
        SELECT TRY_CAST(trim(code) AS DOUBLE) AS whole, TRY_CAST(substr(code, 1, 4) AS DOUBLE) AS head FROM (
          SELECT CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 'abc' WHEN l_orderkey % 19 = 0 THEN '0'
            ELSE CAST(1000 + CAST(trunc(l_extendedprice) AS BIGINT) % 90000 AS VARCHAR) || ' ' END AS code FROM lineitem))) GROUP BY counterparty"""


@query("counterparties", _counterparty_sql())
def counterparties(spark, d):
    key = F.col("l_orderkey")
    code = (
        F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, "abc").when(key % 19 == 0, "0")
        .otherwise(F.concat((F.lit(1000) + F.col("l_extendedprice").cast("bigint") % 90000).cast("string"), F.lit(" ")))
    )
    trx = load(spark, d, "lineitem").select(code.alias("code"))
    return TR.counterparty(trx, "code").groupBy("counterparty").agg(F.count(F.lit(1)).alias("n"))


NAMES = ["smal", "ringg", "widgt", "blu", "bolts", "geer", "gizmos", "xx", "red", "hot", "cold"]


@query(
    "fuzzy_tokens",
    f"""WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), n AS (SELECT unnest({NAMES}) AS name)
        SELECT p_partkey, token, name, CAST(distance AS INTEGER) AS distance FROM (
          SELECT token, name, levenshtein(token, name) AS distance FROM t, n
          WHERE levenshtein(token, name) <= CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 4 THEN 1 ELSE 2 END)
        JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) USING (token)""",
)
def fuzzy_tokens(spark, d):
    parts = load(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return J.fuzzy_token_join(parts, names, "token", "name").select("p_partkey", "token", "name", "distance")


@query(
    "fuzzy_words_of_texts",
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents),
         c AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)
       SELECT token, word, CAST(levenshtein(token, word) AS INTEGER) AS distance FROM w, c WHERE token <> '' AND word <> ''
         AND abs(length(token) - length(word)) <= 2
         AND levenshtein(token, word) <= CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 4 THEN 1 ELSE 2 END""",
)
def fuzzy_words_of_texts(spark, d):
    def words(table, out):
        return load(spark, d, table).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias(out))

    pairs = J.fuzzy_token_pairs(words("documents", "token"), words("benchmark", "word"), "token", "word")
    return pairs.withColumnsRenamed({"l": "token", "r": "word"})


@query(
    "duplicate_column_names",
    """SELECT col AS "column", count(*) AS n_tables, CAST(sum(n) AS BIGINT) AS n_present FROM (
         SELECT 'doc_id' AS col, count(doc_id) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents
         UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars) FROM documents
         UNION ALL SELECT 'doc_id', count(doc_id) FROM labels UNION ALL SELECT 'quality', count(quality) FROM labels UNION ALL SELECT 'toxic', count(toxic) FROM labels
         UNION ALL SELECT 'item_id', count(item_id) FROM benchmark UNION ALL SELECT 'text', count(text) FROM benchmark
         UNION ALL SELECT 'conv_id', count(conv_id) FROM conversations UNION ALL SELECT 'turn', count(turn) FROM conversations
         UNION ALL SELECT 'role', count(role) FROM conversations UNION ALL SELECT 'text', count(text) FROM conversations
       ) GROUP BY col HAVING count(*) > 1""",
)
def duplicate_column_names(spark, d):
    from riskfeat.operators.profile import duplicate_columns

    return duplicate_columns({t: load(spark, d, t) for t in ("documents", "labels", "benchmark", "conversations")})


@query(
    "merge_key_candidates",
    """SELECT 'text' AS "column", CAST(3 AS BIGINT) AS n_tables, 'benchmark,conversations,documents' AS tables
       WHERE (SELECT count(text) FROM documents) > 0 AND (SELECT count(text) FROM benchmark) > 0 AND (SELECT count(text) FROM conversations) > 0""",
)
def merge_key_candidates(spark, d):
    from riskfeat.operators.profile import merge_key_candidates as candidates

    return candidates({t: load(spark, d, t) for t in ("documents", "labels", "benchmark", "conversations")}, 3, 4)
