from pyspark.sql import functions as F

from riskfeat.functions import columns as C
from riskfeat.functions import text as X
from riskfeat.functions.fixed_values import PAYEE_RULES, STOP_WORDS
from riskfeat.operators import textmatch as T


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def test_clean(spark):
    assert one(spark, "  Åke's BILLÅN 2017, nr 5/47 köp--ä ", X.clean) == "aoke s billaon nr 5 koep ae"
    assert one(spark, "é12 123 maj17 1", X.clean) == "é12 maj17 1"
    assert one(spark, None, X.clean) is None
    assert one(spark, "!!!", X.clean) == ""


def test_tokens_keep_short_ones_out(spark):
    assert one(spark, "a bc_d, Efg - é xy", lambda c: X.tokens(c, 2)) == ["bc_d", "efg", "xy"]


def test_stop_words_and_sorting(spark):
    arr = F.array(*[F.lit(w) for w in ["Faktura", "telia", "ab", "telia"]])
    assert one(spark, "", lambda c: X.without_words(arr, STOP_WORDS)) == ["telia", "telia"]
    assert one(spark, "", lambda c: X.sorted_text(arr)) == "Faktura ab telia telia"


def test_ngrams(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "id int, w array<string>")
    assert [r["ngrams"] for r in X.ngrams(df, "w", 2).orderBy("id").collect()] == [["a b", "b c"], [], []]


def test_phrases_need_borders_and_prefer_longer(spark):
    df = spark.createDataFrame([("abc bank x",), ("bank",), ("bankabc",), ("x abc",), ("a.c",)], "t string")
    phrases = ["abc", "abc bank", "bank", "", "a.c"]
    assert {r["t"]: r["match"] for r in T.matched_phrase(df, "t", phrases).collect()} == {
        "abc bank x": "abc bank", "bank": "bank", "bankabc": "", "x abc": "abc", "a.c": "a.c",
    }
    assert T.contains_any(df, "t", phrases).count() == 4
    assert T.contains_any(df, "t", ["", " "]).count() == 0


def test_phrase_table_agrees_with_pattern(spark):
    rows = [(i, t) for i, t in enumerate(["abc bank x", "bank", "bankabc", "x  abc", "", "x abc bank"])]
    df = spark.createDataFrame(rows, "id int, t string")
    table = spark.createDataFrame([("abc bank",), ("bank",), (" ",)], "phrase string")
    by_table = {r["id"] for r in T.contains_any(df, "t", table, ["id"]).collect()}
    assert by_table == {r["id"] for r in T.contains_any(df, "t", ["abc bank", "bank"]).collect()} == {0, 1, 5}


def test_rules(spark):
    df = spark.createDataFrame([("foersaekring kort",), ("swedbank",), ("x swedbankabc",), ("energi liv",), ("abc",)], "t string")
    got = [r["category"] for r in T.categorize(df, "t", PAYEE_RULES).collect()]
    assert got == ["card", "Swedbank", "other", "insurance", "other"]


def test_identify_accounts(spark):
    rows = [
        (1, "abc bank", 50, 5.0), (1, "hyra", 40, 4.0), (1, "abc lan", 30, 3.0), (2, "abc bank", 9, 1.0), (2, "x", 100, 1.0),
        (3, "y", 90, 9.0), (4, "abc bank", 20, 1.0), (4, "abc", 20, 2.0), (None, "abc", 99, 1.0),
    ]
    df = spark.createDataFrame(rows, "acc int, t string, n int, amt double")
    got = {r["acc"]: (r["t"], r["n"], r["amt"]) for r in T.identify_accounts(df, "acc", "t", "n", "amt", ["abc", "abc bank"]).collect()}
    # Account 4: both texts share the highest count, the larger amount names it, both are summed.
    assert got == {1: ("abc bank", 50, 5.0), 4: ("abc", 40, 3.0)}


def test_fuzzy_match(spark):
    texts = spark.createDataFrame([(1, "Betala SANTANDR bnk"), (2, "hyra")], "id int, t string")
    names = spark.createDataFrame([("Santander Bank",)], "name string")
    got = {(r["id"], r["distance"]) for r in T.fuzzy_match(texts, names, "id", "t", "name", STOP_WORDS).collect()}
    assert got == {(1, 1)}


def test_token_report_shares(spark):
    df = spark.createDataFrame([(["a", "b"], 3, 10.0), (["a"], 1, 30.0)], "w array<string>, n int, amt double")
    r = {x["token"]: x for x in T.token_report(df, "w", "n", "amt").collect()}
    assert (r["a"]["token_freq"], r["a"]["freq_n"], r["a"]["freq_amount"]) == (100.0, 100.0, 100.0)
    assert (r["b"]["token_freq"], r["b"]["freq_n"], r["b"]["freq_amount"]) == (50.0, 75.0, 25.0)


def test_inline_examples(spark):
    assert one(spark, "abcd", lambda c: F.instr(c, "b")) == 2
    words = "To be or not to be"
    assert one(spark, words, lambda c: F.size(F.split(c, " "))) == 6
    assert one(spark, words, lambda c: F.size(F.array_distinct(F.split(c, " ")))) == 5
    assert one(spark, words, lambda c: F.size(F.array_distinct(F.transform(F.split(c, " "), F.lower)))) == 4
    assert one(spark, words, lambda c: C.tokens_where(F.split(c, " "), lambda t: F.length(t) > 3)) == []
    assert one(spark, "@nltk Text analysis is awesome! #regex #pandas #python", lambda c: C.find_all(c, "#[A-Za-z0-9]+")) == ["#regex", "#pandas", "#python"]
    assert one(spark, "435", lambda c: C.pad(c, 10)) == "0000000435"
    assert one(spark, "00000000435", lambda c: C.strip(c, "0")) == "435"
    assert one(spark, "the quick brown fox jumped over a lazy dog", lambda c: C.split_at(c, "fox")) == ["the quick brown ", "fox", " jumped over a lazy dog"]
    assert one(spark, "hello world", C.title) == "Hello World"
    assert one(spark, "201801", C.dash_month) == "2018-01"


def test_html_text(spark):
    html = '<h1 class="big main">A <b>b</b>\n c</h1><h1>second</h1><p class=x>y</p>'
    assert one(spark, html, lambda c: X.html_text(c, "h1")) == "A b c"
    assert one(spark, html, lambda c: X.html_text(c, "h1", "main")) == "A b c"
    assert one(spark, html, lambda c: X.html_text(c, "p", "x")) == "y"
    assert one(spark, html, lambda c: X.html_text(c, "h1", "mai")) == ""


def test_letters_and_digits_are_those_of_the_negated_class(spark):
    """Every code point, alone and between letters, is cleaned as the class [^A-Za-zÀ-ÿ0-9] says; it is written as ranges."""
    from riskfeat.functions.fixed_values import NOT_LETTER_OR_DIGIT

    assert "[^" not in NOT_LETTER_OR_DIGIT
    code = F.when(F.col("id") < 0xD800, F.col("id")).otherwise(F.col("id") + 0x800)
    one = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # after a mark of byte order
    points = spark.range(0x110000 - 0x800).select(one.alias("c")).select("c", F.concat(F.lit("a "), "c", "c", F.lit("-b")).alias("t"))
    differ = [~F.regexp_replace(x, NOT_LETTER_OR_DIGIT, " ").eqNullSafe(F.regexp_replace(x, "[^A-Za-zÀ-ÿ0-9]+", " ")) for x in ("c", "t")]
    assert points.where(F.length("c") == 1).count() == 0x110000 - 0x800
    assert points.where(differ[0] | differ[1]).count() == 0
