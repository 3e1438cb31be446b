"""Registered queries against DuckDB, a brute-force version or held-out labels."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from small import table

from riskfeat.llm.plans import tokenizer_file
from riskfeat.llm.queries import BOOK

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", [n for n, q in BOOK.items() if q.sql is not None])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = BOOK[name].run(spark, FOLDER)
    got = table(df.collect(), df.columns)
    cur = con.execute(BOOK[name].sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == table(cur.fetchall(), cols)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in BOOK) == list(range(1, 14))


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    got = {r["doc_id"]: r for r in BOOK["op1_token_files"].run(spark, FOLDER).collect()}
    start = 0
    for d in sorted(read("documents"), key=lambda r: r["doc_id"]):
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_fingerprints_against_direct_edits(spark):
    rows = sorted(read("documents"), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in BOOK["op4_fingerprints"].run(spark, FOLDER).collect()}
    texts = {}
    for k, d in enumerate(rows):
        text, after = d["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= r["near_edited"] <= 1
        texts.setdefault(r["fingerprint"], set()).add(text)
    assert all(len(t) == 1 for t in texts.values()) and len(texts) == len({d["text"] for d in rows})


def test_languages_on_held_out_documents(spark):
    lang = {d["doc_id"]: d["lang"] for d in read("documents")}
    rows = BOOK["op3_language"].run(spark, FOLDER).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_quality_on_held_out_documents(spark):
    label = {d["doc_id"]: d["quality"] for d in read("labels")}
    rows = BOOK["op5_quality"].run(spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.85


def test_toxicity_on_held_out_documents(spark):
    label = {d["doc_id"]: d["toxic"] for d in read("labels")}
    rows = BOOK["op12_toxicity"].run(spark, FOLDER).collect()
    assert len(rows) == len(read("documents"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    # The smallest table has about a dozen toxic documents to learn from.
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.7
