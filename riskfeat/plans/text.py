"""Text operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.functions import text as X
from riskfeat.functions.fixed_values import KEPT_SHORT_TOKENS, PAYEE_RULES, STOP_WORDS
from riskfeat.operators import embeddings as E
from riskfeat.operators import models as M
from riskfeat.operators import phrases as PH
from riskfeat.operators import textmatch as T
from riskfeat.operators import vocabulary as V
from riskfeat.plans.base import load, money, query, r6
from riskfeat.runtime import spread


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean_sql(text: str) -> str:
    letters = f"regexp_replace(lower({text}), '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g')"
    spelled = f"replace(replace(replace({letters}, 'å', 'ao'), 'ä', 'ae'), 'ö', 'oe')"
    return f"array_to_string(list_filter(string_split({spelled}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]{{2,}}')), ' ')"


def tokens_sql(text: str, min_len: int = 2) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\W'), lambda t: length(t) >= {min_len})"


STOP_SQL = f"lambda t: t NOT IN ({quoted(STOP_WORDS)})"
CLEANED = f"cleaned AS (SELECT doc_id, n_chars, {clean_sql('text')} AS t FROM documents)"
WORDS = f"{CLEANED}, w AS (SELECT doc_id, n_chars, {tokens_sql('t')} AS words FROM cleaned)"


def cleaned(spark, d):
    return X.clean_text(spread(load(spark, d, "documents").select("doc_id", "n_chars", "text")), "text", "t")


def worded(spark, d):
    """Words are computed once; what explodes them later does not clean the text again per step."""
    words = X.tokenize(cleaned(spark, d), "t", "words")
    return X.computed_once(words, ["doc_id", "n_chars"], words=F.col("words"))


@query("clean_text", f"WITH {CLEANED} SELECT doc_id, t FROM cleaned")
def clean_text(spark, d):
    return cleaned(spark, d).select("doc_id", "t")


@query("tokenize", f"WITH {WORDS} SELECT doc_id, array_to_string(words, ' ') AS words FROM w")
def tokenize(spark, d):
    return worded(spark, d).select("doc_id", F.array_join("words", " ").alias("words"))


@query(
    "whitespace_tokens",
    r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s'), lambda t: t <> ''), ' ') AS words FROM conversations",
)
def whitespace_tokens(spark, d):
    c = M.whitespace_tokenizer("text").transform(load(spark, d, "conversations").select("conv_id", "turn", "text"))
    return c.select("conv_id", "turn", F.array_join(F.filter("words", lambda t: t != ""), " ").alias("words"))


@query("remove_stopwords", f"WITH {WORDS} SELECT doc_id, array_to_string(list_filter(words, {STOP_SQL}), ' ') AS kept FROM w")
def remove_stopwords(spark, d):
    out = X.remove_stopwords(worded(spark, d), "words", "kept", STOP_WORDS)
    return out.select("doc_id", F.array_join("kept", " ").alias("kept"))


@query(
    "word_frequency",
    f"WITH {WORDS} SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(words, {STOP_SQL})) AS word FROM w) GROUP BY word",
)
def word_frequency(spark, d):
    return T.word_frequency(worded(spark, d), "words", STOP_WORDS)


REPORT = f"""{WORDS}, p AS (SELECT doc_id % 7 + 1 AS n, n_chars AS vol, words FROM w), e AS (SELECT unnest(words) AS token, n, vol FROM p),
  g AS (SELECT token, count(*) AS occurrences, CAST(sum(n) AS BIGINT) AS n, CAST(sum(vol) AS BIGINT) AS amount FROM e GROUP BY token),
  report AS (SELECT *, 100.0 * occurrences / (SELECT count(*) FROM g) AS token_freq, 100.0 * n / (SELECT sum(n) FROM p) AS freq_n,
    100.0 * amount / (SELECT sum(vol) FROM p) AS freq_amount FROM g)"""


def _report(spark, d):
    p = worded(spark, d).select((F.col("doc_id") % 7 + 1).alias("n"), F.col("n_chars").alias("vol"), "words")
    return T.token_report(p, "words", "n", "vol")


@query(
    "token_report",
    f"WITH {REPORT} SELECT token, occurrences, n, amount, round(token_freq, 6) AS token_freq, round(freq_n, 6) AS freq_n, round(freq_amount, 6) AS freq_amount FROM report",
)
def token_report(spark, d):
    return _report(spark, d).withColumns({c: r6(c) for c in ("token_freq", "freq_n", "freq_amount")})


@query(
    "short_token_candidates",
    f"WITH {REPORT} SELECT token, round(freq_n, 6) AS freq_n FROM report WHERE length(token) <= 2 AND token NOT IN ({quoted(KEPT_SHORT_TOKENS)})",
)
def short_token_candidates(spark, d):
    return T.token_candidates(_report(spark, d), max_len=2, by="freq_n").select("token", r6("freq_n").alias("freq_n"))


@query("rare_token_candidates", f"WITH {REPORT} SELECT token, occurrences FROM report WHERE token_freq < 0.033")
def rare_token_candidates(spark, d):
    return T.token_candidates(_report(spark, d), below=0.033, keep=()).select("token", "occurrences")


@query(
    "sorted_words",
    "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted FROM part",
)
def sorted_words(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return X.sorted_words(p, "w", "sorted").select("p_partkey", "sorted")


@query(
    "word_bigrams",
    f"""WITH {WORDS} SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w)
        GROUP BY gram""",
)
def word_bigrams(spark, d):
    grams = X.ngrams(worded(spark, d), "words", 2).select(F.explode("ngrams").alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


PHRASES = ["the the", "and", "ich", "small ring", "der", "les", "card"]
PATTERN_SQL = r"(^|\s)(" + "|".join(sorted(PHRASES, key=lambda p: (-len(p), p))) + r")(\s|$)"


@query("texts_with_phrase", f"WITH {CLEANED} SELECT doc_id FROM cleaned WHERE regexp_matches(t, '{PATTERN_SQL}')")
def texts_with_phrase(spark, d):
    return T.contains_any(cleaned(spark, d), "t", PHRASES).select("doc_id")


@query(
    "phrase_table_hits",
    f"""WITH {CLEANED}, b AS (SELECT string_split({clean_sql('text')}, ' ') AS w FROM benchmark),
        phrases AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM b),
        grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2])) AS phrase
                  FROM (SELECT doc_id, string_split(t, ' ') AS s FROM cleaned))
        SELECT doc_id, phrase FROM grams JOIN phrases USING (phrase)""",
)
def phrase_table_hits(spark, d):
    words = X.computed_once(load(spark, d, "benchmark"), [], w=F.split(X.clean(F.col("text")), " "))
    phrases = X.ngrams(words, "w", 3).select(F.explode("ngrams").alias("phrase"))
    return T.phrase_hits(cleaned(spark, d), "t", phrases, ["doc_id"])


@query(
    "first_phrase_of_table",
    f"""WITH {CLEANED}, b AS (SELECT string_split({clean_sql('text')}, ' ') AS w FROM benchmark),
        phrases AS (SELECT DISTINCT phrase FROM (
          SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + (len(w) + i) % 12], ' '))) AS phrase FROM b) WHERE phrase <> ''),
        listed AS MATERIALIZED (SELECT phrase, len(string_split(phrase, ' ')) AS n, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS head FROM phrases),
        s AS MATERIALIZED (SELECT doc_id, string_split(t, ' ') AS s FROM cleaned WHERE t <> ''),
        w AS (SELECT doc_id, unnest(s) AS one, unnest(range(1, len(s) + 1)) AS i FROM s),
        g AS MATERIALIZED (SELECT doc_id, i, one, one || ' ' || lead(one) OVER (PARTITION BY doc_id ORDER BY i) AS two FROM w),
        near AS MATERIALIZED (SELECT doc_id, i, n, phrase FROM g JOIN listed ON two = head WHERE n > 1),
        hit AS (SELECT doc_id, i - 1 AS position, n, phrase AS match FROM near JOIN s USING (doc_id) WHERE array_to_string(s[i:i + n - 1], ' ') = phrase
          UNION ALL SELECT doc_id, i - 1, n, phrase FROM g JOIN listed ON one = phrase WHERE n = 1)
        SELECT doc_id, CAST(position AS INTEGER) AS position, match, CAST(n AS INTEGER) AS n_words FROM hit
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY position, n DESC) = 1""",
)
def first_phrase_of_table(spark, d):
    """The first phrase of a table that each text holds; from each word of an item on, a phrase of 1 to 12 words."""
    words = X.computed_once(load(spark, d, "benchmark"), [], w=F.split(X.clean(F.col("text")), " "))
    lengths = F.transform("w", lambda _, i: F.array_join(F.slice("w", i + 1, (F.size("w") + i + 1) % 12 + 1), " "))
    return PH.first_phrase(cleaned(spark, d), "t", words.select(F.explode(lengths).alias("phrase")), ["doc_id"])


@query(
    "matched_phrase",
    f"WITH {CLEANED} SELECT doc_id, regexp_extract(t, '{PATTERN_SQL}', 2) AS match, CAST(length(regexp_extract(t, '{PATTERN_SQL}', 2)) AS INTEGER) AS match_len FROM cleaned",
)
def matched_phrase(spark, d):
    return T.matched_phrase(cleaned(spark, d), "t", PHRASES).select("doc_id", "match", "match_len")


def _rules_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({col}), '{'|'.join(words)}') THEN '{name}'" for name, words in PAYEE_RULES) + " ELSE 'other' END"


@query("payee_categories", f"WITH {CLEANED} SELECT doc_id, {_rules_sql('t')} AS category FROM cleaned")
def payee_categories(spark, d):
    return T.categorize(cleaned(spark, d), "t", PAYEE_RULES).select("doc_id", "category")


PAYEES = ["small ring", "red widget", "hot gear", "blue bolt", "old bolt", "ring"]
PAYEE_SQL = r"(^|\s)(" + "|".join(sorted(PAYEES, key=lambda p: (-len(p), p))) + r")(\s|$)"


@query(
    "payment_accounts",
    f"""WITH p AS (SELECT l_suppkey AS account, p_name AS t, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        r AS (SELECT *, dense_rank() OVER (PARTITION BY account ORDER BY n DESC) AS rank FROM p WHERE n > 4
              AND account IN (SELECT account FROM p WHERE regexp_matches(t, '{PAYEE_SQL}'))),
        top AS (SELECT * FROM r WHERE rank <= 2 AND regexp_matches(t, '{PAYEE_SQL}'))
        SELECT account, t, a.n, a.amount FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, amount DESC, t) AS rn FROM top) x
        JOIN (SELECT account, CAST(sum(n) AS BIGINT) AS n, round(sum(amount), 2) AS amount FROM top GROUP BY account) a USING (account) WHERE rn = 1""",
)
def payment_accounts(spark, d):
    li = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = li.groupBy(F.col("l_suppkey").alias("account"), F.col("p_name").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("amount")
    )
    out = T.identify_accounts(p, "account", "t", "n", "amount", PAYEES, more_than=4)
    return out.withColumn("amount", F.round("amount", 2))


@query(
    "document_frequency_weights",
    f"""WITH {WORDS}, k AS (SELECT doc_id, list_filter(words, {STOP_SQL}) AS words FROM w),
        f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(words) AS term FROM k) GROUP BY term)
        SELECT term, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS idf FROM f WHERE df >= 2""",
)
def document_frequency_weights(spark, d):
    kept = X.remove_stopwords(worded(spark, d), "words", "kept", STOP_WORDS)
    terms = V.dictionary(V.term_counts(kept, "doc_id", "kept"), min_docs=2)
    return terms.select("term", r6(V.idf(load(spark, d, "documents").count())).alias("idf"))


@query("term_counts", f"WITH {WORDS} SELECT doc_id, CAST(len(words) AS DOUBLE) AS terms FROM w")
def term_counts(spark, d):
    w = worded(spark, d)
    counts = V.term_counts(w, "doc_id", "words")
    arrays = V.folded(counts, "doc_id", V.dictionary(counts))
    total = F.aggregate("value", F.lit(0.0), lambda a, b: a + b)
    return w.select("doc_id").join(arrays, "doc_id", "left").select("doc_id", F.coalesce(total, F.lit(0.0)).alias("terms"))


@query(
    "term_vectors",
    f"""WITH {WORDS}, c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY doc_id, term),
        v AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, encode(term)) - 1 AS index, count(*) AS docs FROM c GROUP BY term)
        SELECT doc_id, index, CAST(n AS DOUBLE) AS n, round(n * ln(((SELECT count(*) FROM documents) + 1) / (docs + 1)), 6) AS weight FROM c JOIN v USING (term)""",
)
def term_vectors(spark, d):
    """Every slot of every document's sparse vector: the term's number, its count and its weight."""
    counts = V.term_counts(worded(spark, d), "doc_id", "words")
    terms = V.dictionary(counts)
    whole = load(spark, d, "documents").count()
    known = counts.where(F.col("doc_id").isNotNull())
    slots = V.folded_values(known, "doc_id", terms, n=F.col("n"), weight=F.col("n") * V.idf(whole))
    return slots.select("doc_id", F.inline(F.arrays_zip("index", "n", "weight"))).withColumn("weight", r6("weight"))


@query("hashed_term_counts", f"WITH {WORDS} SELECT doc_id, CAST(len(words) AS DOUBLE) AS terms FROM w")
def hashed_term_counts(spark, d):
    from pyspark.ml.functions import vector_to_array

    hashed = M.hash_tf("words", "tf", 1 << 12).transform(worded(spark, d))
    return hashed.select("doc_id", F.aggregate(vector_to_array("tf"), F.lit(0.0), lambda a, b: a + b).alias("terms"))


@query("word_embeddings")
def word_embeddings(spark, d):
    return E.row_vectors(worded(spark, d), "doc_id", "words")


@query(
    "fuzzy_names",
    r"""WITH t AS (SELECT page_id, url, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g'), '\W'),
          lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]{2,}'))) AS ws FROM pages), tw AS (SELECT page_id, url, unnest(ws) AS l FROM t),
        n AS (SELECT s_name AS name FROM supplier UNION SELECT p_name FROM part UNION SELECT source FROM documents),
        nw AS (SELECT DISTINCT name, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), '\W'),
          lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]{2,}'))) AS r FROM n),
        pairs AS (SELECT l, r, levenshtein(l, r) AS distance FROM (SELECT DISTINCT l FROM tw), (SELECT DISTINCT r FROM nw)
          WHERE levenshtein(l, r) <= CASE WHEN length(l) <= 2 THEN 0 WHEN length(l) <= 4 THEN 1 ELSE 2 END)
        SELECT DISTINCT name, page_id, url, CAST(distance AS INTEGER) AS distance FROM pairs JOIN tw USING (l) JOIN nw USING (r)""",
)
def fuzzy_names(spark, d):
    names = (
        load(spark, d, "supplier").select(F.col("s_name").alias("name"))
        .unionByName(load(spark, d, "part").select(F.col("p_name").alias("name")))
        .unionByName(load(spark, d, "documents").select(F.col("source").alias("name")))
    )
    texts = load(spark, d, "pages").select("page_id", "url")
    return T.fuzzy_match(texts, names, "page_id", "url", "name", ())


