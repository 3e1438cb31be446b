"""Phrase and proximity matches against a scan of the words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from small import prose

from riskfeat.llm import decontaminate as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in [*low, " "]:
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def scan(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        for k in range(max(1, len(own) - window + 1)) if own else ():
            phrase = own[k:k + window]
            for i in range(len(w) - len(phrase) + 1):
                if w[i:i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items():
    r = random.Random(8)
    return [(i, prose(r, 14)) for i in range(100, 106)] + [
        (1, "one Two"), (2, None), (3, " .. "), (4, "again and again again and again"), (4, prose(r, 12)), (None, "x 中文"), (12, "row WITHOUT id"),
    ]


@pytest.fixture(scope="module")
def rows(odd, items):
    r = random.Random(2)
    own = [(x["doc_id"], x["text"]) for x in odd.collect()]
    planted = [(200 + k, f"{prose(r, 9)} {t.upper() if t else ''}!! {prose(r, 7)} {t}") for k, (_, t) in enumerate(items)]
    return own + planted


@pytest.fixture(scope="module")
def tables(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("window", [3, 10])
def test_counts_equal_a_scan(tables, rows, items, window):
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(set(r["items"])))) for r in (
            x.asDict() | {"n_hit": len({p for a, b in zip(x["hits"][::2], x["hits"][1::2], strict=True) for p in range(a, b)})}
            for x in dc.matches(*tables, window=window).collect()
        )), key=str)
    want = sorted(((i, n, h, tuple(f)) for i, (n, h, f) in ((i, scan(t, items, window)) for i, t in rows)), key=str)
    assert got == want


def test_items_in_blocks_give_the_same(tables, monkeypatch):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    whole = sorted(map(tuple, dc.contamination(*tables).select(*cols).collect()), key=str)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, dc.contamination(*tables).select(*cols).collect()), key=str) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c y d"), (3, "d c b a"), (4, "a b x x x x c d")], "doc_id bigint, text string")
    item = spark.createDataFrame([(7, "a b c d")], "item_id bigint, text string")
    hit = lambda slop: sorted(r["doc_id"] for r in dc.contamination(docs, item, slop=slop).where("contaminated").collect())
    assert hit(0) == [1] and hit(2) == [1, 2] and 4 in hit(4)


def test_clean_keeps_rows_whole(spark, odd, nothing):
    item = spark.createDataFrame([(1, "one two three"), (2, "a row without id")], "item_id bigint, text string")
    kept = dc.clean(odd, item)
    assert kept.schema == odd.schema
    gone = odd.exceptAll(kept).collect()
    assert sorted(r["text"] for r in gone) == ["a row without id", "one two three", "one two three"]
    assert dc.clean(nothing, item).count() == 0
    assert dc.clean(odd, item.limit(0)).count() == odd.count()


def test_a_shard_is_indexed_in_portions(monkeypatch):
    """Words of a shard are held a portion at a time; positions run on as in one piece."""
    ids, texts = pa.array(range(9)), pa.array(["a b c d", "", "b a", "c " * 50, "d", "a-b", "x y z", "b", "a c"])
    terms = np.unique(dc.Words(pa.array(["a b c d"]), dc.ALPHANUMERIC).hash)
    whole = dc._index_slice(ids, ids, texts, terms, 0)
    real, seen = dc.slices, []
    monkeypatch.setattr(dc, "slices", lambda t: (seen.append(1), real(t, 8))[1])
    assert dc._index_slice(ids, ids, texts, terms, 0).equals(whole) and seen
