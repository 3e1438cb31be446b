"""One query per operator, over whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from riskfeat.llm import alignment, chat, decontaminate, filter_audit, fingerprints, jaccard, language, mixing, quality, token_counts, token_files, toxicity, warc
from riskfeat.llm.base import load, query
from riskfeat.runtime import shared_folder


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark, d):
    path = f"{shared_folder(spark, 'token-files')}/orc"
    token_files.write(load(spark, d, "documents"), path, tokenizer_file())
    return token_files.digests(token_files.read(spark, path))


MIX_SQL = r"""WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
filled AS (
  SELECT *, row_number() OVER o AS k,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM ranked WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
level AS (SELECT k, above, below FROM filled WHERE 3 * source_size * below > above * w ORDER BY k LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN l.k IS NULL OR f.k < l.k THEN (3 * f.source_size)::DOUBLE ELSE l.above::DOUBLE * f.w / l.below::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('0:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
chosen AS (SELECT *, floor(rate)::BIGINT + (CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS copies FROM rates)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM chosen"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark, d):
    return mixing.mix(load(spark, d, "documents"))


LEAK_SQL = r"""WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM doc_window d JOIN item_window i ON d.n = i.n AND d.phrase = i.phrase),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id"""


@query("op8_decontaminate", LEAK_SQL)
def op8_decontaminate(spark, d):
    return decontaminate.contamination(load(spark, d, "documents"), load(spark, d, "benchmark")).drop("text_key")


WARC_SQL = """WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
winner AS (SELECT payload_digest, max(page_id) AS winner FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN w.winner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM page p LEFT JOIN winner w ON p.payload_digest = w.payload_digest"""


@query("op10_warc", WARC_SQL)
def op10_warc(spark, d):
    folder = shared_folder(spark, "warc")
    warc.write(load(spark, d, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# A conversation whose texts are nothing but the format's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = r"""WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
f AS (
  SELECT *, length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant')::BIGINT AS n_examples,
  coalesce(sum(CASE WHEN role = 'assistant' THEN upto END), 0)::BIGINT AS example_chars
FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM f) GROUP BY conv_id"""


@query("op9_chat", CHAT_SQL)
def op9_chat(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], turns.schema)
    folder = shared_folder(spark, "chat")
    chat.write(turns.unionByName(marks), f"{folder}/turns")
    rows = chat.read(spark, f"{folder}/turns")
    return chat.digests(rows, chat.expand(rows, f"{folder}/examples"))


@query("op4_fingerprints")
def op4_fingerprints(spark, d):
    return fingerprints.fingerprints(load(spark, d, "documents"))


@query("op3_language")
def op3_language(spark, d):
    return language.identify(load(spark, d, "documents"), language.held_out(2, 4))


@query("op5_quality")
def op5_quality(spark, d):
    return quality.classify(load(spark, d, "documents"), load(spark, d, "labels"), language.held_out(0, 5))


@query("op6_token_counts")
def op6_token_counts(spark, d):
    return token_counts.token_counts(load(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


JACCARD_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.other), w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN reach r ON w.doc_id = r.doc_id GROUP BY w.doc_id, n.n"""


@query("op7_jaccard_join", JACCARD_SQL)
def op7_jaccard_join(spark, d):
    return jaccard.joined(load(spark, d, "documents"))


AUDIT_SQL = r"""WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM doc GROUP BY text),
label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
mask AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > f.first_id THEN 'E' ELSE '' END) AS fails
  FROM doc d JOIN firsts f ON d.text = f.text LEFT JOIN label l ON d.doc_id = l.doc_id),
cell AS (SELECT part, fails, good, toxic, count(*) AS n FROM mask GROUP BY ALL),
perm AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM perm, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
step AS (
  SELECT filter_order, k::INTEGER AS step, filter_order[k] AS f, filter_order[1:k - 1] AS before
  FROM perm, (SELECT unnest(range(1, 6)) AS k) WHERE length(filter_order) = 5),
per_step AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM cell c, step s GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM per_step"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark, d):
    return filter_audit.audit(load(spark, d, "documents"), load(spark, d, "labels"))


@query("op12_toxicity")
def op12_toxicity(spark, d):
    return toxicity.classify(load(spark, d, "documents"), load(spark, d, "labels"), language.held_out(1, 3))


@query("op13_alignment")
def op13_alignment(spark, d):
    return alignment.align(load(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
