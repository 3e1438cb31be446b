"""Bins, weight of evidence and information value on a feature table with made gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.operators import binning as B
from riskfeat.plans.base import FEATURES, HOLES_SQL, query, r6, with_holes


def _long_sql(source: str = "feats", cols=FEATURES, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra}'{c}' AS feature, label, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols)


def bins_sql(keys: str, long: str, cells: int = 10) -> str:
    """Long rows with their quantile bin: the largest cell number without repeated edges."""
    qs = ", ".join(f"[{', '.join(f'quantile_cont(value, {i}/{k}::DOUBLE)' for i in range(k + 1))}]" for k in range(cells, 0, -1))
    return f"""long AS ({long}),
      cand AS (SELECT {keys}, [{qs}] AS cands FROM long WHERE value IS NOT NULL GROUP BY {keys}),
      edges AS (SELECT {keys}, coalesce(list_filter(cands, lambda e: len(list_distinct(e)) = len(e))[1], cands[{cells}]) AS e FROM cand),
      binned AS (SELECT l.*, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda x: value > x)) END AS bin
                 FROM long l LEFT JOIN edges USING ({keys}))"""


def woe_sql(keys: str) -> str:
    on = keys
    return f"""bins AS (SELECT {keys}, CAST(bin AS INTEGER) AS bin, min(CASE WHEN bin = -1 THEN -1 ELSE value END) AS bin_min, max(CASE WHEN bin = -1 THEN -1 ELSE value END) AS bin_max,
        CAST(sum(label) AS BIGINT) AS events, count(*) AS total FROM binned GROUP BY {keys}, bin),
      tot AS (SELECT {keys}, sum(events) AS e, sum(total - events) AS n FROM bins GROUP BY {keys}),
      shares AS (SELECT b.*, events / e::DOUBLE AS event_pct, (total - events) / n::DOUBLE AS nonevent_pct FROM bins b JOIN tot USING ({on})),
      woe AS (SELECT *, CASE WHEN event_pct = 0 AND nonevent_pct = 0 THEN NULL WHEN nonevent_pct = 0 THEN 'Infinity'::DOUBLE WHEN event_pct = 0 THEN '-Infinity'::DOUBLE
        ELSE ln(event_pct / nonevent_pct) END AS woe FROM shares)"""


BASE = f"WITH {HOLES_SQL}, {bins_sql('feature', _long_sql())}, {woe_sql('feature')}"
WOE_ROWS = ["event_pct", "nonevent_pct", "woe", "iv"]


def _binned(spark, d):
    return B.quantile_bins(with_holes(spark, d), FEATURES, ["label"])


@query("quantile_bins", f"{BASE} SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM binned GROUP BY feature, bin")
def quantile_bins(spark, d):
    return _binned(spark, d).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(
    "weight_of_evidence",
    f"""{BASE} SELECT feature, bin, bin_min, bin_max, events, total, round(event_pct, 6) AS event_pct, round(nonevent_pct, 6) AS nonevent_pct,
        round(woe, 6) AS woe, round((event_pct - nonevent_pct) * woe, 6) AS iv FROM woe""",
)
def weight_of_evidence(spark, d):
    return B.woe_table(_binned(spark, d), "label").withColumns({c: r6(c) for c in WOE_ROWS})


@query(
    "good_bad_table",
    f"""{BASE} SELECT feature, bin, total - events AS good, events AS bad, total, bin_min AS min, round(bin_max + 0.1, 6) AS max, round(nonevent_pct, 6) AS good_pct,
        round(event_pct, 6) AS bad_pct, round(total / (SELECT count(*) FROM feats)::DOUBLE, 6) AS total_pct, round(events / total::DOUBLE, 6) AS bad_rate,
        round(-woe, 6) AS woe, round((event_pct - nonevent_pct) * woe, 6) AS iv FROM woe""",
)
def good_bad_table(spark, d):
    t = B.quantile_woe(with_holes(spark, d), FEATURES, "label")
    return t.withColumns({c: r6(c) for c in ("max", "good_pct", "bad_pct", "total_pct", "bad_rate", "woe", "iv")})


@query("bin_report", f'{BASE} SELECT feature, bin AS cell, events AS "default", total, bin_max, bin_min FROM bins')
def bin_report(spark, d):
    return B.bin_report(B.woe_table(_binned(spark, d), "label"))


@query("bad_rates", f"{BASE} SELECT feature, bin, round(events / total::DOUBLE, 6) AS bad_rate FROM bins")
def bad_rates(spark, d):
    return B.bad_rate(B.woe_table(_binned(spark, d), "label")).withColumn("bad_rate", r6("bad_rate"))


PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing, round(count(*) FILTER ({c} = 0) / count(*)::DOUBLE, 6) AS zero, count(DISTINCT {c}) AS n_unique FROM feats"
    for c in FEATURES
)


@query(
    "iv_summary",
    f"{BASE} SELECT p.*, i.iv FROM ({PROFILE}) p JOIN (SELECT feature, round(sum((event_pct - nonevent_pct) * woe), 6) AS iv FROM woe GROUP BY feature) i USING (feature)",
)
def iv_summary(spark, d):
    return B.iv_summary(with_holes(spark, d), FEATURES, "label").withColumns({c: r6(c) for c in ("missing", "zero", "iv")})


@query(
    "features_by_iv",
    f"{BASE} SELECT feature FROM (SELECT feature, sum((event_pct - nonevent_pct) * woe) AS iv FROM woe GROUP BY feature) WHERE iv >= 0.0002",
)
def features_by_iv(spark, d):
    iv = B.total_iv(B.woe_table(_binned(spark, d), "label"))
    return B.select_by_iv(iv, 0.0002).select("feature")


def _sweep_long() -> tuple[str, str]:
    """SQL of the medians, and of the long rows of every fill."""
    med = ", ".join(f"(SELECT quantile_cont(CASE WHEN {c} <> 0 THEN {c} END, 0.5) FROM feats) AS m_{c}" for c in FEATURES)
    parts = []
    for c in FEATURES:
        for fill, e in (("none", c), ("zero", f"coalesce({c}, 0)"), ("median", f"coalesce(nullif({c}, 0), m_{c}, 0)")):
            parts.append(f"SELECT segment, '{fill}' AS fill, '{c}' AS feature, label, CAST({e} AS DOUBLE) AS value FROM feats CROSS JOIN med")
    return f"SELECT {med}", " UNION ALL ".join(parts)


def _sweep_sql() -> str:
    med, long = _sweep_long()
    keys = "segment, fill, feature"
    return f"""WITH {HOLES_SQL}, med AS ({med}), {bins_sql(keys, long)}, {woe_sql(keys)}
        SELECT segment, fill, feature, round(sum((event_pct - nonevent_pct) * woe), 6) AS iv FROM woe GROUP BY {keys}"""


@query("iv_sweep", _sweep_sql())
def iv_sweep(spark, d):
    return B.iv_sweep(with_holes(spark, d), FEATURES, "label", "segment").withColumn("iv", r6("iv"))


def _first_split_sql() -> str:
    nh = lambda g, b: f"(-(CASE WHEN {g} > 0 THEN {g} * ln({g} / ({g} + {b})::DOUBLE) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * ln({b} / ({g} + {b})::DOUBLE) ELSE 0 END))"
    return f"""WITH {HOLES_SQL}, long AS ({_long_sql()}),
      h AS (SELECT feature, value, count(*) FILTER (label = 0) AS g, count(*) FILTER (label = 1) AS b FROM long WHERE value IS NOT NULL GROUP BY feature, value),
      c AS (SELECT feature, value, lead(value) OVER w AS nxt, CAST(sum(g) OVER w AS BIGINT) AS gl, CAST(sum(b) OVER w AS BIGINT) AS bl,
              CAST(sum(g) OVER (PARTITION BY feature) AS BIGINT) AS ga, CAST(sum(b) OVER (PARTITION BY feature) AS BIGINT) AS ba FROM h WINDOW w AS (PARTITION BY feature ORDER BY value)),
      s AS (SELECT feature, value + (nxt - value) / 2 AS cut, {nh('ga', 'ba')} - {nh('gl', 'bl')} - {nh('(ga - gl)', '(ba - bl)')} AS gain FROM c
            WHERE nxt IS NOT NULL AND gl + bl >= ceil(0.05 * (ga + ba)) AND ga + ba - gl - bl >= ceil(0.05 * (ga + ba)))
      SELECT feature, round(cut, 6) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, cut) AS rn FROM s) WHERE rn = 1"""


@query("first_entropy_cut", _first_split_sql())
def first_entropy_cut(spark, d):
    edges = B.tree_boundaries(with_holes(spark, d), FEATURES, "label", leaves=2)
    return edges.select("feature", r6(F.col("edges")[1]).alias("cut"))


def _tree_sql(keys: str, long: str, leaves: int = 6) -> str:
    """Long rows with their entropy bin: the rounds of the best-first tree, written out one after the other."""
    nh = lambda g, b: f"(-(CASE WHEN {g} > 0 THEN {g} * ln({g} / ({g} + {b})::DOUBLE) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * ln({b} / ({g} + {b})::DOUBLE) ELSE 0 END))"
    leaf = "lo, hi, g0, b0, g, b, need"
    parts = [
        f"long AS MATERIALIZED ({long})",
        f"h AS (SELECT {keys}, value, count(*) FILTER (label = 0) AS g, count(*) FILTER (label = 1) AS b FROM long WHERE value IS NOT NULL GROUP BY {keys}, value)",
        f"""c AS MATERIALIZED (SELECT {keys}, value, lead(value) OVER w AS nxt, CAST(sum(g) OVER w AS BIGINT) AS cg, CAST(sum(b) OVER w AS BIGINT) AS cb
              FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY value))""",
        f"ends AS MATERIALIZED (SELECT {keys}, min(value) AS least, max(value) AS most, max(cg) AS g, max(cb) AS b FROM c GROUP BY {keys})",
        f"""fresh0 AS (SELECT {keys}, '-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi, 0::BIGINT AS g0, 0::BIGINT AS b0, g, b,
              CAST(ceil(0.05 * (g + b)) AS BIGINT) AS need FROM ends)""",
    ]
    for k in range(leaves - 1):
        older = f" UNION ALL SELECT {keys}, {leaf}, cut, cg, cb, gain FROM open{k - 1} WHERE rn > 1" if k else ""
        parts += [
            f"""try{k} AS (SELECT {keys}, {leaf}, value + (nxt - value) / 2 AS cut, cg, cb,
                  round({nh('g', 'b')} - {nh('(cg - g0)', '(cb - b0)')} - {nh('(g - cg + g0)', '(b - cb + b0)')}, 9) AS gain
                FROM c JOIN fresh{k} USING ({keys}) WHERE g > 0 AND b > 0 AND value >= lo AND value < hi AND nxt < hi
                  AND cg - g0 + cb - b0 >= need AND g + b - (cg - g0 + cb - b0) >= need)""",
            f"""best{k} AS (SELECT {keys}, {leaf}, cut, cg, cb, gain FROM try{k} WHERE gain > 0
                QUALIFY row_number() OVER (PARTITION BY {keys}, lo ORDER BY gain DESC, cut) = 1)""",
            f"""open{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC, cut) AS rn
                FROM (SELECT * FROM best{k}{older}))""",
            f"""fresh{k + 1} AS (SELECT {keys}, lo, cut AS hi, g0, b0, cg - g0 AS g, cb - b0 AS b, need FROM open{k} WHERE rn = 1
                UNION ALL SELECT {keys}, cut, hi, cg, cb, g - cg + g0, b - cb + b0, need FROM open{k} WHERE rn = 1)""",
        ]
    union = " UNION ALL ".join(f"SELECT {keys}, cut FROM open{k} WHERE rn = 1" for k in range(leaves - 1))
    parts += [
        f"edges AS MATERIALIZED (SELECT {keys}, least, most, e FROM ends LEFT JOIN (SELECT {keys}, list(cut ORDER BY cut) AS e FROM ({union}) GROUP BY {keys}) USING ({keys}))",
        f"""binned AS (SELECT l.*, CAST(CASE WHEN value IS NULL THEN -1 ELSE coalesce(len(list_filter(e, lambda x: value >= x)), 0) END AS INTEGER) AS bin
              FROM long l LEFT JOIN edges USING ({keys}))""",
    ]
    return ", ".join(parts)


@query(
    "entropy_boundaries",
    f"""WITH {HOLES_SQL}, {_tree_sql('feature', _long_sql())}
        SELECT feature, list_transform(list_sort(list_distinct(list_concat([least, most + 0.1], coalesce(e, [])))), lambda x: round(x, 6)) AS edges FROM edges""",
)
def entropy_boundaries(spark, d):
    edges = B.tree_boundaries(with_holes(spark, d), FEATURES, "label")
    return edges.select("feature", F.transform("edges", lambda x: F.round(x, 6)).alias("edges"))


def _tree_woe_sql(kept: str) -> str:
    return f"""WITH {HOLES_SQL}, {_tree_sql('feature', _long_sql())}, rows_kept AS (SELECT * FROM binned WHERE {kept}), {woe_sql('feature').replace('FROM binned', 'FROM rows_kept')}
        SELECT feature, bin, total - events AS good, events AS bad, total, bin_min AS min, bin_max AS max, round(nonevent_pct, 6) AS good_pct, round(event_pct, 6) AS bad_pct,
          round(total / sum(total) OVER (PARTITION BY feature)::DOUBLE, 6) AS total_pct, round(events / total::DOUBLE, 6) AS bad_rate,
          round(-woe, 6) AS woe, round((event_pct - nonevent_pct) * woe, 6) AS iv FROM woe"""


TREE_ROWS = ["good_pct", "bad_pct", "total_pct", "bad_rate", "woe", "iv"]


@query("entropy_woe", _tree_woe_sql("bin <> -1"))
def entropy_woe(spark, d):
    return B.tree_woe(with_holes(spark, d), FEATURES, "label").withColumns({c: r6(c) for c in TREE_ROWS})


@query("entropy_woe_missing_bin", _tree_woe_sql("true"))
def entropy_woe_missing_bin(spark, d):
    return B.tree_woe(with_holes(spark, d), FEATURES, "label", missing="bin").withColumns({c: r6(c) for c in TREE_ROWS})


def _tree_sweep_sql() -> str:
    med, long = _sweep_long()
    keys = "segment, fill, feature"
    return f"""WITH {HOLES_SQL}, med AS ({med}), {_tree_sql(keys, long)}, {woe_sql(keys)}
        SELECT segment, fill, feature, round(sum((event_pct - nonevent_pct) * woe), 6) AS iv FROM woe GROUP BY {keys}"""


@query("entropy_iv_sweep", _tree_sweep_sql())
def entropy_iv_sweep(spark, d):
    return B.iv_sweep(with_holes(spark, d), FEATURES, "label", "segment", method="tree").withColumn("iv", r6("iv"))
