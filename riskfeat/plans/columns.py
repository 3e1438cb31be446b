"""Projections, filters and column functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskfeat.functions import columns as C
from riskfeat.functions import text as X
from riskfeat.operators import rows as R
from riskfeat.plans.base import load, money, money_sql, query
from riskfeat.runtime import checkpoint_dir, cut_lineage
from riskfeat.sources import files, sinks, tables


@query("select_and_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_and_drop(spark, d):
    return load(spark, d, "orders").drop("o_orderstatus").select("o_orderkey", "o_custkey", "o_totalprice")


@query("sql_scan", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 1000")
def sql_scan(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("customer_scan")
    return tables.sql(spark, "select c_custkey, c_mktsegment from customer_scan where c_acctbal > 1000")


@query(
    "named_views",
    "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def named_views(spark, d):
    return tables.with_views(
        {"view_orders": load(spark, d, "orders"), "view_customer": load(spark, d, "customer")},
        "select o.o_orderkey, c.c_name, o.o_totalprice from view_orders o join view_customer c on o.o_custkey = c.c_custkey",
    )


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _scratch(spark)
    customer = load(spark, d, "customer")
    sinks.save_csv(customer, path)
    return files.read_lookup(spark, path, customer.schema, ",")


@query("semicolon_lookup", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def semicolon_lookup(spark, d):
    path = _scratch(spark)
    nation = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.save_csv(nation, path, sep=";")
    return files.read_lookup(spark, path, nation.schema)


@query(
    "orc_table_round_trip",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
)
def orc_table_round_trip(spark, d):
    """A managed ORC table written, replaced by rows read from itself, scanned by name, and removed."""
    name = f"saved_orders_{uuid.uuid4().hex}"
    sinks.save_table(load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), name, "orc", ["o_orderstatus"])
    sinks.save_table(tables.table(spark, name).where(F.col("o_orderstatus") != "P"), name, "orc", ["o_orderstatus"])
    kept = cut_lineage(tables.table(spark, name))
    sinks.drop_table(spark, name)
    return kept


@query("csv_as_text", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_as_text(spark, d):
    path = _scratch(spark)
    sinks.save_csv(load(spark, d, "supplier"), path)
    return files.read_csv(spark, path).select("s_suppkey", "s_name", "s_nationkey")


@query("csv_inferred", "SELECT p_partkey::INTEGER AS p_partkey, p_name, p_retailprice FROM part")
def csv_inferred(spark, d):
    path = _scratch(spark)
    sinks.save_csv(load(spark, d, "part"), path)
    return files.read_csv(spark, path, infer=True).select("p_partkey", "p_name", "p_retailprice")


@query("parquet_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_round_trip(spark, d):
    path = _scratch(spark)
    sinks.save_parquet(load(spark, d, "orders"), path)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "text_line_words",
    """SELECT word, count(*) AS n FROM (
         SELECT unnest(string_split(line, ' ')) AS word FROM (
           SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE word <> '' GROUP BY word""",
)
def text_line_words(spark, d):
    path = _scratch(spark)
    load(spark, d, "documents").select("text").write.text(path)
    return files.line_words(files.read_lines(spark, path)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("select_expressions", "SELECT o_orderkey, o_totalprice * 2 AS double_price, upper(o_orderpriority) AS priority FROM orders")
def select_expressions(spark, d):
    return load(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice * 2 as double_price", "upper(o_orderpriority) as priority")


@query("tag_and_rename", "SELECT c_custkey AS party, c_acctbal AS balance, 'train' AS data, 1 AS one FROM customer")
def tag_and_rename(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    df = df.withColumnRenamed("c_custkey", "party").withColumnRenamed("c_acctbal", "balance")
    return df.withColumn("data", F.lit("train")).withColumn("one", F.lit(1))


@query("prefix_columns", "SELECT n_nationkey, n_name AS base_n_name, n_regionkey AS base_n_regionkey FROM nation")
def prefix_columns(spark, d):
    return C.prefix_columns(load(spark, d, "nation"), "base_", ["n_nationkey"])


@query("strip_prefix", "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice FROM orders")
def strip_prefix(spark, d):
    return C.strip_prefix(load(spark, d, "orders"), "o_").select("orderkey", "custkey", "totalprice")


@query(
    "cast_columns",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
              TRY_CAST(o_orderstatus AS INTEGER) AS no_number, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS DOUBLE) AS money FROM orders""",
)
def cast_columns(spark, d):
    df = load(spark, d, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderstatus").alias("no_number"),
        F.col("o_totalprice").alias("whole"), F.col("o_totalprice").alias("money"),
    )
    cast = C.cast_columns(df, {"int": ["level", "no_number"], "bigint": ["whole"], "decimal(16,2)": ["money"]})
    return cast.withColumn("money", F.col("money").cast("double"))


@query(
    "filter_comparisons",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 50000) OR NOT (o_totalprice >= 1000)",
)
def filter_comparisons(spark, d):
    o = load(spark, d, "orders")
    return o.where(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000)) | ~(F.col("o_totalprice") >= 1000)).select("o_orderkey")


@query("filter_sql_text", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 10")
def filter_sql_text(spark, d):
    return load(spark, d, "events").filter("event_type = 'click' and value > 10").select("event_id", "value")


@query(
    "filter_in_lists",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')",
)
def filter_in_lists(spark, d):
    o = load(spark, d, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR upper(p_type) LIKE 'ECO%'")
def filter_like(spark, d):
    return load(spark, d, "part").where(F.lower("p_name").like("%ring%") | F.upper("p_type").like("ECO%")).select("p_partkey", "p_name")


@query(
    "filter_regex",
    r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4}') AND NOT regexp_matches(text, 'https?://')",
)
def filter_regex(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").where(t.rlike("[0-9]{4}") & ~t.rlike("https?://")).select("doc_id")


@query(
    "filter_missing",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE (CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_discount END) IS NULL
         AND (CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END) IS NOT NULL""",
)
def filter_missing(spark, d):
    li = load(spark, d, "lineitem").withColumns(
        {
            "made_a": F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, F.col("l_discount")),
            "made_b": F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")),
        }
    )
    return li.where(F.col("made_a").isNull() & F.col("made_b").isNotNull()).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "filter_has_tokens",
    r"""SELECT page_id FROM pages
        WHERE len(list_filter(regexp_split_to_array(lower(url), '[^a-z]'), lambda t: length(t) >= 8)) > 0""",
)
def filter_has_tokens(spark, d):
    p = load(spark, d, "pages").withColumn("t", F.filter(F.split(F.lower("url"), "[^a-z]"), lambda t: F.length(t) >= 8))
    return p.where(C.has_tokens("t")).select("page_id")


@query(
    "filter_ranges",
    """SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000
       AND strftime(o_orderdate, '%Y-%m') >= '1996-01' AND strftime(o_orderdate, '%Y-%m') < '1999-06'""",
)
def filter_ranges(spark, d):
    o = load(spark, d, "orders").where(F.col("o_totalprice").between(1000, 200000))
    day, kind = F.col("o_orderdate"), o.schema["o_orderdate"].dataType
    # The stored column itself is compared, so that the range reaches the scan.
    return o.where((day >= F.lit("1996-01-01").cast(kind)) & (day < F.lit("1999-06-01").cast(kind))).select("o_orderkey")


@query(
    "case_branches",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size_class
       FROM part""",
)
def case_branches(spark, d):
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return load(spark, d, "part").select("p_partkey", size.alias("size_class"))


@query(
    "sentinel_to_null",
    """SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment,
              CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_name END AS c_name FROM customer""",
)
def sentinel_to_null(spark, d):
    c = load(spark, d, "customer")
    coded = c.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", " NA ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_nationkey") % 4 == 0, "NA").otherwise(F.col("c_name")).alias("c_name"),
    )
    return C.sentinel_to_null(coded, ["c_mktsegment", "c_name"])


@query(
    "flags",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done,
       CASE WHEN nullif(o_orderpriority, '5-LOW') IS NOT NULL AND o_totalprice > 100000 THEN 1 ELSE 0 END AS watched FROM orders""",
)
def flags(spark, d):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return load(spark, d, "orders").select(
        "o_orderkey", C.flag("o_orderstatus", "F").alias("done"),
        C.flag_when(priority.isNotNull() & (F.col("o_totalprice") > 100000)).alias("watched"),
    )


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id FROM orders")
def row_ids(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.add_id(o, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "id")


@query(
    "sum_columns_of_type",
    f"""SELECT {money_sql('l_quantity')} AS l_quantity, {money_sql('l_extendedprice')} AS l_extendedprice,
               {money_sql('l_discount')} AS l_discount, {money_sql('l_tax')} AS l_tax FROM lineitem""",
)
def sum_columns_of_type(spark, d):
    li = load(spark, d, "lineitem")
    return li.agg(*[money(c).alias(c) for c in C.columns_of_type(li, "double")])


@query(
    "map_columns",
    """SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type FROM part""",
)
def map_columns(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return C.map_columns(p, F.lower, C.columns_of_type(p, "string"))


@query(
    "text_functions",
    r"""SELECT p_partkey, upper(p_name) AS up, trim('  ' || p_type || ' ') AS trimmed,
        regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits, regexp_extract(p_brand, '#(\d+)', 1) AS brand_no,
        CAST(length(p_name) AS INTEGER) AS len, p_brand || p_type AS joined, concat_ws('-', p_brand, p_type) AS dashed,
        substr(p_name, 1, 4) AS head, CAST(instr(p_name, 'o') AS INTEGER) AS at_o FROM part""",
)
def text_functions(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"),
        F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
        F.regexp_replace("p_brand", "[^0-9]+", "").alias("digits"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_no"),
        F.length("p_name").alias("len"), F.concat("p_brand", "p_type").alias("joined"),
        F.concat_ws("-", "p_brand", "p_type").alias("dashed"), F.substring("p_name", 1, 4).alias("head"),
        F.instr("p_name", "o").alias("at_o"),
    )


@query(
    "split_and_explode",
    """SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, words[pos] AS word FROM (
         SELECT doc_id, string_split(text, ' ') AS words, unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM documents)""",
)
def split_and_explode(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query(
    "brands_by_type",
    "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type",
)
def brands_by_type(spark, d):
    pairs = load(spark, d, "part").select("p_type", F.explode_outer(F.array("p_brand")).alias("brand"))
    # Brands form a short fixed list, and the set is built from distinct pairs.
    sets = pairs.distinct().groupBy("p_type").agg(F.collect_set("brand").alias("s"))
    return sets.select("p_type", F.array_join(F.array_sort("s"), ",").alias("brands"))


@query(
    "edit_distance",
    """SELECT p_partkey, CAST(levenshtein(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS INTEGER) AS distance FROM part""",
)
def edit_distance(spark, d):
    w = F.split("p_name", " ")
    return load(spark, d, "part").select("p_partkey", F.levenshtein(w[0], w[1]).alias("distance"))


@query("base64_ids", "SELECT c_custkey, base64(encode(c_name)) AS id FROM customer")
def base64_ids(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("id"))


@query(
    "numeric_functions",
    """SELECT s_suppkey, abs(s_acctbal - 5000) AS gap, round(s_acctbal, 0) AS rounded,
       CASE WHEN round(s_acctbal, 2) > 0 OR round(s_acctbal, 2) < 0 THEN 1 ELSE 0 END AS not_zero,
       CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal / 1000), 6) ELSE NULL END AS log_ratio FROM supplier""",
)
def numeric_functions(spark, d):
    b = F.col("s_acctbal")
    return load(spark, d, "supplier").select(
        "s_suppkey", F.abs(b - 5000).alias("gap"), F.round(b, 0).alias("rounded"),
        C.flag_when((F.round(b, 2) > 0) | (F.round(b, 2) < 0)).alias("not_zero"),
        F.when(b > 0, F.round(C.log_ratio(b, F.lit(1000)), 6)).alias("log_ratio"),
    )


@query(
    "row_sums",
    """SELECT l_orderkey, l_linenumber,
       round(coalesce(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 6) AS total
       FROM lineitem""",
)
def row_sums(spark, d):
    li = load(spark, d, "lineitem").withColumn("q", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
    out = C.sum_features(li, ["q", "l_discount", "l_tax"], "total", ["l_orderkey", "l_linenumber"])
    return out.withColumn("total", F.round("total", 6))


@query(
    "date_functions",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 6 MONTH, '%Y-%m-%d') AS half_year_on,
       strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_back, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS ten_days_on,
       CAST(date_diff('month', DATE '1995-01-01', date_trunc('month', o_orderdate)) AS DOUBLE) AS months,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day,
       strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%-d') AS day, strftime(o_orderdate, '%a') AS weekday,
       strftime(o_orderdate, '%Y-%m') AS dashed FROM orders""",
)
def date_functions(spark, d):
    day = F.to_date("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return load(spark, d, "orders").select(
        "o_orderkey", text(F.add_months(day, 6)).alias("half_year_on"), text(F.add_months(day, -1)).alias("month_back"),
        text(F.date_add(day, 10)).alias("ten_days_on"),
        F.months_between(C.month_start(day), F.lit("1995-01-01").cast("date")).alias("months"),
        text(C.month_start(day)).alias("first_day"), text(C.month_end(day)).alias("last_day"),
        C.date_part_text(day, "year").alias("year"), C.date_part_text(day, "day").alias("day"),
        C.date_part_text(day, "weekday").alias("weekday"), C.dash_month(C.date_part_text(day, "month")).alias("dashed"),
    )


@query("token_counts", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_items FROM documents")
def token_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", C.n_items(F.split("text", " ")).alias("n_items"))


@query("random_columns")
def random_columns(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.rand(10).alias("uniform"), F.randn(27).alias("normal"))


@query(
    "case_strip_pad",
    """SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title, trim(p_brand, 'B0') AS stripped,
       CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 10 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS padded,
       CASE WHEN starts_with(p_name, 'small') THEN 1 ELSE 0 END AS is_small, CASE WHEN ends_with(p_name, 'ring') THEN 1 ELSE 0 END AS is_ring,
       replace(p_name, ' ', '_') AS joined FROM part""",
)
def case_strip_pad(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", C.title("p_type").alias("title"), C.strip("p_brand", "B0").alias("stripped"),
        C.pad(F.col("p_partkey").cast("string"), 10).alias("padded"),
        F.col("p_name").startswith("small").cast("int").alias("is_small"), F.col("p_name").endswith("ring").cast("int").alias("is_ring"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"),
    )


@query(
    "token_filters",
    r"""SELECT doc_id, CAST(len(list_filter(w, lambda t: length(t) > 3)) AS INTEGER) AS longer, CAST(len(list_filter(w, lambda t: regexp_full_match(t, '[A-Z][a-z]*'))) AS INTEGER) AS titled,
        CAST(len(list_filter(w, lambda t: ends_with(t, 'en'))) AS INTEGER) AS in_en, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct,
        CAST(len(list_distinct(list_transform(w, lambda t: lower(t)))) AS INTEGER) AS n_folded
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def token_filters(spark, d):
    w = F.split("text", " ")
    return load(spark, d, "documents").select(
        "doc_id", F.size(C.tokens_where(w, lambda t: F.length(t) > 3)).alias("longer"),
        F.size(C.tokens_where(w, C.is_title_case)).alias("titled"),
        F.size(C.tokens_where(w, lambda t: t.endswith("en"))).alias("in_en"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        F.size(F.array_distinct(F.transform(w, F.lower))).alias("n_folded"),
    )


@query(
    "find_all",
    r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '#[A-Za-z0-9]+'), ' ') AS tags,
        array_to_string(regexp_extract_all(text, '@[A-Za-z0-9]+'), ' ') AS callouts,
        array_to_string(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+'), ' ') AS mails,
        array_to_string(regexp_extract_all(text, '[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}'), ' ') AS dates FROM documents""",
)
def find_all(spark, d):
    hits = lambda p: F.array_join(C.find_all("text", p), " ")
    return load(spark, d, "documents").select(
        "doc_id", hits("#[A-Za-z0-9]+").alias("tags"), hits("@[A-Za-z0-9]+").alias("callouts"),
        hits("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+").alias("mails"), hits("[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}").alias("dates"),
    )


@query(
    "split_at_word",
    """SELECT doc_id, CASE WHEN hit > 0 THEN substr(text, 1, hit - 1) ELSE text END AS before_it,
              CASE WHEN hit > 0 THEN 'the' ELSE '' END AS it, CASE WHEN hit > 0 THEN substr(text, hit + 3) ELSE '' END AS after_it,
              CASE WHEN hit > 0 THEN substr(text, 1, hit - 1) || '|the|' || substr(text, hit + 3) ELSE text || '||' END AS joined
       FROM (SELECT doc_id, text, instr(text, 'the') AS hit FROM documents)""",
)
def split_at_word(spark, d):
    parts = load(spark, d, "documents").select("doc_id", C.split_at("text", "the").alias("p"))
    return parts.select(
        "doc_id", F.col("p")[0].alias("before_it"), F.col("p")[1].alias("it"), F.col("p")[2].alias("after_it"),
        F.array_join("p", "|").alias("joined"),
    )


@query(
    "html_fields",
    r"""SELECT page_id,
          trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
          trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading
        FROM pages""",
)
def html_fields(spark, d):
    html = F.col("html")
    return load(spark, d, "pages").select("page_id", X.html_text(html, "title").alias("title"), X.html_text(html, "h1").alias("heading"))
