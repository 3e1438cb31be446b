"""The plans the queries are meant to have."""

import pytest

from riskfeat.plans.catalog import BOOK

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return BOOK[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_party_totals_reads_only_what_it_needs(spark):
    text = plan(spark, "party_totals")
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text and "GreaterThan(c_acctbal" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp" in text
    # Amounts are summed before the join.
    assert "HashAggregate" in text.split("Join", 1)[1]


@pytest.mark.parametrize("name", ["best_row_per_key", "top_values_per_group"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


@pytest.mark.parametrize(
    "name",
    [
        "fuzzy_tokens", "fuzzy_words_of_texts", "fuzzy_names", "counterparties", "lookback_events", "lookback_features", "share_of_total",
        "token_report", "weight_of_evidence", "iv_sweep", "payment_accounts", "phrase_table_hits", "area_under_curves", "histogram",
        "price_range_table", "first_phrase_of_table", "entropy_woe", "entropy_iv_sweep",
    ],
)
def test_no_pairwise_comparison(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["counterparties", "offset_pairs", "clean_text", "texts_with_phrase", "iv_summary", "model_coefficients"])
def test_no_python_workers(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "ArrowEval" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["overview", "population_report", "feature_profile", "describe"])
def test_profiles_scan_once(spark, name):
    name = {"overview": "column_overview"}.get(name, name)
    assert plan(spark, name).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["word_frequency", "token_report", "rare_token_candidates"])
def test_texts_are_cleaned_below_the_explode_only(spark, name):
    """One cleaning takes three replacements; what comes after it reads its result."""
    text = plan(spark, name)
    assert text.count("regexp_replace") <= 3 * max(1, text.count("FileScan"))


def test_token_report_cleans_texts_once(spark):
    """Tokens, their number and the totals are read from counts that are put aside; no text is cleaned for them again."""
    assert "regexp_replace" not in plan(spark, "token_report")
