"""Flows per party, offsetting transfers, counterparties, look-back features, edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.fixed_values import CLEARING_RANGES, OTHER_COUNTERPARTY
from riskfeat.operators.joins import attach_roles, range_lookup
from riskfeat.operators.rows import offset_pairs


def monthly_flow(
    df: DataFrame, keys: list[str], type_col: str, amount: str, name: str,
    codes: Sequence | None = None, exclude: Sequence | None = None,
) -> DataFrame:
    """sum_<name> and count_<name> per key, over the listed type codes or without the excluded ones."""
    if codes is not None:
        df = df.where(F.col(type_col).isin(list(codes)))
    if exclude is not None:
        df = df.where(~F.col(type_col).isin(list(exclude)))
    return df.groupBy(*keys).agg(F.sum(amount).alias(f"sum_{name}"), F.count(amount).alias(f"count_{name}"))


def net_type(
    df: DataFrame, keys: list[str], type_col: str, amount: str, codes: Sequence, tag: str, name: str
) -> DataFrame:
    """Several type codes netted into one pseudo type."""
    return monthly_flow(df, keys, type_col, amount, name, codes=codes).withColumn(type_col, F.lit(tag))


def daily_totals(df: DataFrame, date: str, amount: str) -> DataFrame:
    """(date, n, avg_amount, sum_amount), the amounts as whole numbers."""
    day = F.to_date(F.col(date)).alias("date")
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.avg(amount)).alias("avg_amount"),
        F.floor(F.sum(amount)).alias("sum_amount"),
    ).orderBy("date")


def transfer_flags(df: DataFrame, party: str, other: str) -> DataFrame:
    """to_self and to_other; both 0 when the counterparty is unknown."""
    return df.withColumns(
        {
            "to_self": F.when(F.col(party) == F.col(other), 1).otherwise(0),
            "to_other": F.when(F.col(party) != F.col(other), 1).otherwise(0),
        }
    )


def own_transfer_flags(
    trx: DataFrame, links: DataFrame, own_type: str, checked_types: Sequence[str], keep_flags: bool = False
) -> DataFrame:
    """Transfers that stay with the party, flagged and left out.

    ``own_type`` is always an own transfer.  Of ``checked_types`` it is one when only the other
    agreement is known and either side holds a role on the other's agreement.  Rows are kept when no
    flag is set.
    """
    roles = attach_roles(trx, links)
    only_agreement = (
        F.col("sec_account_type").isNull() & F.col("sec_clearing").isNull() & F.col("sec_account").isNull()
        & F.col("sec_agreement").isNotNull()
    )
    has_role = F.col("sec_role_on_main").isNotNull() | F.col("main_role_on_sec").isNotNull()
    flags = {f"own_{own_type}": F.when(F.col("type") == own_type, 1).otherwise(0)}
    for t in checked_types:
        flags[f"own_{t}"] = F.when((F.col("type") == t) & only_agreement & has_role, 1).otherwise(0)
    flagged = roles.withColumns(flags)
    if keep_flags:
        return flagged
    return flagged.where(" and ".join(f"`{f}` = 0" for f in flags)).drop(*flags)


def residual_flow(
    df: DataFrame, party: str, date: str, month: str, type_col: str, amount: str, row_id: str,
    drop_type: str | None, codes: Sequence,
) -> DataFrame:
    """Income per party, month and type that is left once offsetting rows are taken out, twice:
    first within the same type, then, without ``drop_type``, across types."""
    first = offset_pairs(df, party, date, amount, type_col, row_id).where(F.col("sum_check") == 0)
    rest = first.drop("sum_check")
    if drop_type is not None:
        rest = rest.where(F.col(type_col) != drop_type)
    second = offset_pairs(rest, party, date, amount, None, row_id, largest_first=True)
    left = second.where(F.col("sum_check") == 0)
    return monthly_flow(left, [party, month, type_col], type_col, amount, "income", codes=codes)


def counterparty(df: DataFrame, clearing: str, ranges=CLEARING_RANGES, out: str = "counterparty") -> DataFrame:
    return range_lookup(df, clearing, ranges, out, OTHER_COUNTERPARTY)


def lookback_features(
    anchor: DataFrame, events: DataFrame, party: str, anchor_month: str, event_date: str, amount: str, months: int
) -> DataFrame:
    """Per anchor: n, sum, avg, std and flag over the ``months`` whole months before the anchor month.

    Events are reduced to one row per party and month first; each such row then serves the at most
    ``months`` anchor months it falls into.  The join is an equality on (party, anchor month), so a
    party with very many events adds only its months.
    """
    value = F.col(amount).cast("double")
    monthly = events.groupBy(F.col(party), F.trunc(F.col(event_date), "month").alias("_m")).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"), F.avg(value).alias("_a"), F.var_pop(value).alias("_v")
    )
    served = monthly.withColumn(
        "_anchor", F.explode(F.transform(F.sequence(F.lit(1), F.lit(months)), lambda i: F.add_months(F.col("_m"), i)))
    )
    per_anchor = served.groupBy(party, "_anchor").agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("sum"),
        F.sum(F.col("_v") * F.col("_n")).alias("_within"),
        # Spread of the month means: the count-weighted square sum of the means around their own mean.
        F.sum(F.col("_n") * F.col("_a") * F.col("_a")).alias("_means2"),
    )
    n, s = F.col("n"), F.col("sum")
    between = F.greatest(F.col("_means2") - F.try_divide(s * s, n), F.lit(0.0))
    features = per_anchor.select(
        party, "_anchor", "n", "sum",
        F.try_divide(s, n).alias("avg"),
        F.when(n > 1, F.sqrt((F.col("_within") + between) / (n - 1))).alias("std"),
    )
    a = anchor.withColumn("_anchor", F.trunc(F.col(anchor_month), "month"))
    return a.join(features, [party, "_anchor"], "left").drop("_anchor").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "flag": F.when(F.col("n") > 0, 1).otherwise(0)}
    )


def party_totals(trx: DataFrame, party: DataFrame, key: str, amount: str) -> DataFrame:
    """Amount and rows per listed party.  Summing comes first, so the join sees one row per party."""
    per_party = trx.groupBy(key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))
    return per_party.join(party.select(key).distinct(), key)


def payment_day(df: DataFrame, party: str, date: str, keep: Sequence[str]) -> DataFrame:
    day = F.date_format(F.col(date), "d")
    return df.select(party, date, *keep, day.alias("day"))


def same_product(df: DataFrame, products: DataFrame, product: str, sec_product: str) -> DataFrame:
    """Rows whose two products agree, with the product's attributes."""
    return df.where(F.col(product) == F.col(sec_product)).join(products, sec_product, "left")


# --- edges ------------------------------------------------------------------------------------


def edges(df: DataFrame, src: str, dst: str, kind: str = "directed", relation: str | None = None, weight: Column | None = None) -> DataFrame:
    """Edge table (src, dst[, relation], weight).

    "undirected" puts the smaller end first and merges both directions, "directed" keeps one edge per
    ordered pair, "multi" one per pair and relation.
    """
    a, b = F.col(src), F.col(dst)
    ends = [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")] if kind == "undirected" else [a.alias("src"), b.alias("dst")]
    if kind == "multi":
        ends.append(F.col(relation).alias("relation"))
    return df.groupBy(*ends).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("weight"))


def edge_attributes(edge_table: DataFrame, attrs: Sequence[str] | None = None) -> DataFrame:
    return edge_table if attrs is None else edge_table.select("src", "dst", *attrs)


def edge_between(edge_table: DataFrame, a, b, directed: bool = True) -> DataFrame:
    forward = (F.col("src") == F.lit(a)) & (F.col("dst") == F.lit(b))
    backward = (F.col("src") == F.lit(b)) & (F.col("dst") == F.lit(a))
    return edge_table.where(forward if directed else forward | backward)
