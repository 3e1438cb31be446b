"""Joins: chains, role look-ups, ranges, look-back windows, edit distance, join-backs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.operators.ordered import number_rows, running_totals
from riskfeat.runtime import broadcast_if_small, same, stored


def chain_left_join(dfs: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "left"), dfs)


def join_trimmed(a: DataFrame, b: DataFrame, ka: str, kb: str, how: str = "inner") -> DataFrame:
    """Equi-join on keys without their padding; ``b``'s key column is left out of the result."""
    b = b.withColumn("_kb", F.trim(F.col(kb))).drop(kb)
    return a.withColumn("_ka", F.trim(F.col(ka))).join(b, F.col("_ka") == F.col("_kb"), how).drop("_ka", "_kb")


def restrict_to(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the parties that appear in ``keys_df``."""
    return df.join(keys_df.select(*keys), keys, "left_semi")


def without_rows_of(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], max_rows: int = 100_000) -> DataFrame:
    """Left join to a look-up table, broadcast only when its row count was checked."""
    return df.join(broadcast_if_small(lookup, max_rows), keys, "left")


def attach_roles(trx: DataFrame, links: DataFrame) -> DataFrame:
    """Role of the counterparty on the main agreement, and of the party on the other agreement.

    ``links`` has (agreement, party, role); ``trx`` has (agreement, party, sec_agreement, sec_party).  A party
    with several roles on one agreement counts with the lowest, so every transfer stays one row.
    """
    links = links.groupBy("agreement", "party").agg(F.min("role").alias("role"))
    main = links.select(
        F.col("agreement"), F.col("party").alias("sec_party"), F.col("role").alias("sec_role_on_main")
    )
    second = links.select(
        F.col("agreement").alias("sec_agreement"), F.col("party"), F.col("role").alias("main_role_on_sec")
    )
    return trx.join(main, ["agreement", "sec_party"], "left").join(second, ["sec_agreement", "party"], "left")


def pair_roles(links: DataFrame, holder: str = "00", co_holder: str = "01") -> DataFrame:
    """Holder with each co-holder of the same agreement."""
    a = links.where(F.col("role") == holder).select("agreement", F.col("party").alias("party"))
    b = links.where(F.col("role") == co_holder).select("agreement", F.col("party").alias("party_sec"))
    return a.join(b, "agreement")


def household(links: DataFrame, party: DataFrame, product: DataFrame) -> DataFrame:
    """Holder and co-holder pairs of active parties, with the agreement's product."""
    pairs = pair_roles(links.select("agreement", "party", "role"))
    product_of = links.where(F.col("role") == "00").select("agreement", "party", "product")
    return (
        pairs.join(party.select("party"), "party", "left_semi")
        .join(product_of, ["agreement", "party"])
        .join(product, "product", "left")
    )


def _segments(ranges: Sequence[tuple[float, float, str]]) -> tuple[list[float], list[str | None]]:
    """Disjoint pieces of the number line and the first range that covers each."""
    after = lambda x: math.nextafter(x, math.inf)
    points = sorted({float(lo) for lo, _, _ in ranges} | {after(float(hi)) for _, hi, _ in ranges})
    names = [
        next((name for lo, hi, name in ranges if lo <= start and start <= hi), None) for start in points
    ]
    return [-math.inf, *points, math.inf], [None, *names]


def range_class(df: DataFrame, value: Column, ranges: Sequence[tuple[float, float, str]], out: str) -> DataFrame:
    """Name of the first closed range [lo, hi] that holds the value, else null.

    The ranges are a short list owned by the caller.  They become disjoint pieces, and each row does
    one binary search in them; there is no join and no shuffle.
    """
    splits, names = _segments(ranges)
    piece = Bucketizer(splits=splits, inputCol="_code", outputCol="_piece", handleInvalid="keep")
    coded = piece.transform(df.withColumn("_code", value.cast("double")))
    name = F.array(*[F.lit(n).cast("string") for n in names])
    found = F.try_element_at(name, F.col("_piece").cast("int") + 1)
    return coded.withColumn(out, F.when(F.col("_code").isNotNull(), found)).drop("_code", "_piece")


def _first_of_pieces(placed: DataFrame, pieces: DataFrame, sizes: int) -> DataFrame:
    """(piece, name): the first range (priority, name) that covers each piece, of ranges of pieces [_from, _to).

    Ranges are cut into power-of-two buckets of pieces, at most two of each size.  A bucket lies in its ranges as a
    whole, so only its first range is kept, and a piece looks at its one bucket of each size: overlaps multiply nothing.
    """
    levels = F.sequence(F.lit(0), F.lit(sizes))

    def buckets_of(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first = F.call_function("shiftright", F.col("_from") + size - 1, level)
        end = F.call_function("shiftright", F.col("_to"), level)
        return F.array(
            F.when((first < end) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("bucket"))),
            F.when((first < end) & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).alias("bucket"))),
        )

    cut = placed.select(F.struct("priority", "name").alias("_r"), F.explode(F.flatten(F.transform(levels, buckets_of))).alias("_b"))
    firsts = cut.where(F.col("_b").isNotNull()).groupBy("_b.level", "_b.bucket").agg(F.min("_r").alias("_r"))
    probes = pieces.select("piece", F.explode(levels).alias("level")).withColumn("bucket", F.call_function("shiftright", "piece", F.col("level")))
    found = probes.join(firsts, ["level", "bucket"]).groupBy("piece").agg(F.min("_r").alias("_r"))
    return found.select("piece", "_r.name")


def range_table_class(df: DataFrame, value: Column, ranges: DataFrame, out: str) -> DataFrame:
    """Name of the closed range that holds the value and has the least priority, of a table of any number of ranges.

    ``ranges`` has (lo, hi, priority, name).  Its ends part the number line into numbered pieces, each with its first
    range; rows and ends are then ordered together, and the ends before a row count to its piece.  So a row is
    shuffled once, whatever the number of ranges that hold it, and no pair of row and range is formed.

    Equal priorities: the lower name.  A range with a null or NaN end, or with lo above hi, holds nothing; a value that is
    null, NaN or no number gets null, and so does every row where there are no ranges.  Rows may repeat; a column
    called ``out`` is replaced.
    """
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    usable = ranges.select(lo.alias("lo"), hi.alias("hi"), "priority", "name").where((F.col("lo") <= F.col("hi")) & ~F.isnan("lo") & ~F.isnan("hi"))
    begin, after = F.struct(F.col("lo").alias("at"), F.lit(0).alias("side")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("side"))
    ends = usable.select(F.inline(F.array(begin, after))).distinct()
    # Piece k goes from end k to the one that follows.
    ends = stored(number_rows(ends, [], ["at", "side"], "piece"), "ends")
    starts = ends.where(F.col("side") == 0).select(F.col("at").alias("lo"), F.col("piece").alias("_from"))
    stops = ends.where(F.col("side") == 2).select(F.col("at").alias("hi"), F.col("piece").alias("_to"))
    placed = usable.join(starts, "lo").join(stops, "hi")
    names = stored(_first_of_pieces(placed, ends.select("piece"), ends.count().bit_length()), "pieces")

    kept = [c for c in df.columns if c != out]
    points = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), value.try_cast("double").alias("at"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("end")
    )
    no_row = F.lit(None).cast(points.schema["row"].dataType)
    both = points.unionByName(ends.select(no_row.alias("row"), "at", "side", F.lit(1).cast("bigint").alias("end")))
    counted = running_totals(both, [], ["at", "side"], {"piece": "end"}).where(F.col("side") == 1).select("row", "piece")
    return counted.join(broadcast_if_small(names), "piece", "left").select("row.*", F.col("name").alias(out))


def range_lookup(
    df: DataFrame, code: str, ranges: Sequence[tuple[str, int, int, str]], out: str, other: str
) -> DataFrame:
    """Class of a text code by ranges of (match on, lo, hi, class); the first range in the list wins.

    "full" compares the whole trimmed code as a number, "prefix4" its first four characters; a code
    that is null or no number gets ``other``.
    """
    trimmed = F.trim(F.col(code))
    forms = {"full": trimmed.try_cast("double"), "prefix4": F.substring(F.col(code), 1, 4).try_cast("double")}
    # Each form yields the position of its first hit; the smaller position is the earlier range.
    for form, number in forms.items():
        mine = [(lo, hi, str(i)) for i, (m, lo, hi, _) in enumerate(ranges) if m == form]
        df = range_class(df, number, mine, f"_{form}") if mine else df.withColumn(f"_{form}", F.lit(None).cast("string"))
    first = F.least(*[F.col(f"_{form}").cast("int") for form in forms])
    classes = F.array(*[F.lit(r[3]) for r in ranges])
    return df.withColumn(out, F.coalesce(F.get(classes, first), F.lit(other))).drop(*[f"_{f}" for f in forms])


def lookback_join(
    anchor: DataFrame, events: DataFrame, party: str, anchor_date: str, event_date: str, months: int
) -> DataFrame:
    """Events of the party in [anchor - months, anchor).

    Each anchor names the calendar months its window touches, so the join is on (party, month)
    rather than on the party alone, and the exact dates are checked after it.
    """
    day = F.to_date(F.col(anchor_date))
    touched = F.sequence(
        F.trunc(F.add_months(day, -months), "month"), F.trunc(F.date_sub(day, 1), "month"), F.expr("interval 1 month")
    )
    a = anchor.withColumn("_month", F.explode(touched))
    e = events.withColumn("_month", F.trunc(F.col(event_date), "month"))
    when = F.to_date(F.col(event_date))
    return (
        a.join(e, [party, "_month"])
        .where((when >= F.add_months(F.to_date(F.col(anchor_date)), -months)) & (when < F.to_date(F.col(anchor_date))))
        .drop("_month")
    )


def aggregate_join_back(df: DataFrame, keys: list[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group results attached to every detail row; a null key is a group too."""
    groups = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    joined = df.alias("a").join(groups.alias("b"), same(keys), "left")
    return joined.select("a.*", *[F.col(f"b.`{n}`") for n in aggs])


def merge_aggregates(*dfs: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), dfs)


def attach_predictions(source: DataFrame, predictions: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return source.join(predictions.select(key, *cols), key, "inner")


def prediction_errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.where(F.col(label) != F.col(prediction))


# --- edit distance ----------------------------------------------------------------------------


def distance_limit(token: Column) -> Column:
    """0 for up to two characters, 1 for three or four, 2 beyond."""
    n = F.length(token)
    return F.when(n <= 2, 0).when(n <= 4, 1).otherwise(2)


LONG_TOKEN = 20


def _one_less(s: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
    )


def _shortened(s: Column, limit: int) -> Column:
    """The token with up to ``limit`` letters left out: two tokens within that distance share one."""
    forms = F.array(s)
    if limit >= 1:
        forms = F.concat(forms, F.when(F.length(s) > 1, _one_less(s)).otherwise(F.array(F.lit(""))))
    if limit >= 2:
        twice = F.flatten(F.transform(_one_less(s), lambda t: F.when(F.length(t) > 1, _one_less(t)).otherwise(F.array(F.lit("")))))
        forms = F.concat(forms, F.when(F.length(s) > 1, twice).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(forms)


def _pieces(s: Column, of_length: Column, shifts: Sequence[int]) -> Column:
    """Three even pieces of a long token: with two edits at least one of them stays whole."""
    size = F.floor(of_length / 3).cast("int")
    return F.flatten(
        F.transform(
            F.array(*[F.lit(i) for i in range(3)]),
            lambda i: F.transform(
                F.filter(F.array(*[F.lit(d) for d in shifts]), lambda d: (i * size + 1 + d) >= 1),
                lambda d: F.concat_ws(
                    "|", of_length.cast("string"), i.cast("string"), F.substring(s, i * size + 1 + d, size)
                ),
            ),
        )
    )


def fuzzy_token_pairs(left: DataFrame, right: DataFrame, lcol: str, rcol: str) -> DataFrame:
    """Distinct token pairs (left, right, distance) within the limit set by the left token's length.

    Only an equality of derived keys is joined, never each with each: short tokens by the spellings
    with letters left out, long ones by pieces that two edits cannot all touch.
    """
    lt = left.select(F.col(lcol).alias("l")).where(F.col("l").isNotNull() & (F.col("l") != "")).distinct()
    rt = right.select(F.col(rcol).alias("r")).where(F.col("r").isNotNull() & (F.col("r") != "")).distinct()
    ln, rn = F.length("l"), F.length("r")
    none = F.array().cast("array<string>")

    def tagged(tag: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(tag), k))

    left_keys = (
        F.when(ln <= 2, F.array(F.concat(F.lit("0:"), F.col("l"))))
        .when(ln <= 4, tagged("1:", _shortened(F.col("l"), 1)))
        .when(ln <= LONG_TOKEN, tagged("2:", _shortened(F.col("l"), 2)))
        .otherwise(tagged("3:", _pieces(F.col("l"), ln, [0])))
    )
    lengths = F.filter(F.transform(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]), lambda d: rn + d), lambda n: n > LONG_TOKEN)
    right_keys = F.concat(
        F.when(rn <= 2, F.array(F.concat(F.lit("0:"), F.col("r")))).otherwise(none),
        F.when(rn.between(2, 5), tagged("1:", _shortened(F.col("r"), 1))).otherwise(none),
        F.when(rn.between(3, LONG_TOKEN + 2), tagged("2:", _shortened(F.col("r"), 2))).otherwise(none),
        tagged("3:", F.flatten(F.transform(lengths, lambda n: _pieces(F.col("r"), n, (-2, -1, 0, 1, 2))))),
    )
    lk = lt.select("l", F.explode(F.array_distinct(left_keys)).alias("_k"))
    rk = rt.select("r", F.explode(F.array_distinct(right_keys)).alias("_k"))
    limit = distance_limit(F.col("l"))
    near = (
        F.when(limit == 0, F.when(F.col("l") == F.col("r"), 0).otherwise(-1))
        .when(limit == 1, F.levenshtein("l", "r", 1))
        .otherwise(F.levenshtein("l", "r", 2))
    )
    return lk.join(rk, "_k").select("l", "r", near.alias("distance")).where(F.col("distance") >= 0).distinct()


def fuzzy_token_join(a: DataFrame, b: DataFrame, ca: str, cb: str) -> DataFrame:
    """Rows of ``a`` and ``b`` whose tokens lie within the limit, with the distance.

    The pairs are found over distinct tokens; rows are attached afterwards.
    """
    pairs = fuzzy_token_pairs(a, b, ca, cb).withColumnsRenamed({"l": ca, "r": cb})
    return a.join(pairs, ca).join(b, cb)
