"""Column functions and column-wise table changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = "Column | str"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- scalar functions -------------------------------------------------------------------------


def log_ratio(a, b) -> Column:
    """ln(a/b): +inf or -inf when just one side is zero, null when both are."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (
        F.when((a == 0) & (b == 0), F.lit(None))
        .when(b == 0, F.lit(float("inf")))
        .when(a == 0, F.lit(float("-inf")))
        .otherwise(F.ln(F.try_divide(a, b)))
    )


def row_sum(cols: Iterable) -> Column:
    """Sum over the columns of one row, nulls counting as 0."""
    return reduce(lambda x, y: x + y, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def month_start(date) -> Column:
    return F.trunc(_c(date), "month")


def month_end(date) -> Column:
    return F.last_day(_c(date))


# Date patterns by unit.
DATE_UNITS = {"year": "yyyy", "month": "yyyyMM", "day": "d", "weekday": "E"}


def date_part_text(date, unit: str) -> Column:
    return F.date_format(_c(date), DATE_UNITS[unit])


def dash_month(yyyymm) -> Column:
    """'201801' to '2018-01'."""
    text = _c(yyyymm).cast("string")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))


def n_items(arr) -> Column:
    return F.size(_c(arr))


def title(text) -> Column:
    return F.initcap(_c(text))


def strip(text, chars: str) -> Column:
    return F.btrim(_c(text), F.lit(chars))


def pad(text, width: int, char: str = "0") -> Column:
    """Left pad up to ``width``; a longer text stays whole."""
    text = _c(text)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, char))


def flag(col, yes: str) -> Column:
    """1 for the given text, 0 for anything else, also for null."""
    return F.when(_c(col) == yes, 1).otherwise(0)


def flag_when(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def find_all(text, pattern: str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))


def tokens_where(arr, keep: Callable[[Column], Column]) -> Column:
    return F.filter(_c(arr), keep)


def is_title_case(token: Column) -> Column:
    return token.rlike("^[A-Z][a-z]*$")


def split_at(text, word: str) -> Column:
    """[before, word, after] around the first hit; [text, '', ''] when there is none."""
    text = _c(text)
    at = F.instr(text, word)
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + len(word), F.length(text))
    return F.when(at > 0, F.array(before, F.lit(word), after)).otherwise(F.array(text, F.lit(""), F.lit("")))


def has_tokens(arr) -> Column:
    """True when the array's first element exists and is not null."""
    return F.coalesce(F.try_element_at(_c(arr), F.lit(1)).isNotNull(), F.lit(False))


def missing_to_null(col) -> Column:
    """NaN to null, so that both count as missing."""
    col = _c(col)
    return F.when(~F.isnan(col), col)


def nan_free(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN to null in the float columns, all of them or those named."""
    floats = {n for n, t in df.dtypes if t in ("float", "double")}
    changed = {c: missing_to_null(F.col(f"`{c}`")) for c in (df.columns if cols is None else cols) if c in floats}
    return df.withColumns(changed) if changed else df


# --- column-wise table changes ----------------------------------------------------------------


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def strip_prefix(df: DataFrame, text: str) -> DataFrame:
    return df.withColumnsRenamed({c: c[len(text):] for c in df.columns if c.startswith(text)})


def cast_columns(df: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """Cast the listed columns per type; text that does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for t, cols in types.items() for c in cols})


def sentinel_to_null(df: DataFrame, cols: Iterable[str], sentinel: str = "NA") -> DataFrame:
    return df.withColumns({c: F.when(F.trim(F.col(c)) != sentinel, F.col(c)) for c in cols})


def map_columns(df: DataFrame, fn: Callable[[Column], Column], cols: Iterable[str] | None = None) -> DataFrame:
    """Apply one column function to all columns or to the named ones, in a single projection."""
    chosen = set(df.columns if cols is None else cols)
    return df.select(*[fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def columns_of_type(df: DataFrame, text: str) -> list[str]:
    """Names of the columns whose type name contains ``text``."""
    return [c for c, t in df.dtypes if text in t]


def unique_types(df: DataFrame) -> list[str]:
    """Type names in order of first appearance."""
    return list(dict.fromkeys(t for _, t in df.dtypes))


def sum_features(df: DataFrame, cols: list[str], new: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, row_sum(cols).alias(new))
