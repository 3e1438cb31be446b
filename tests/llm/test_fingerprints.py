"""Prefix hashes against direct comparison of strings."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskfeat.llm import fingerprints as fp

TEXT = st.text(alphabet="abé中", max_size=60)


def prefix_hash(text):
    return fp.PrefixHash(fp.code_points(text))


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = prefix_hash(a), prefix_hash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i:i + n] == b[j:j + n])
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert x.common_extension(i, y, j) == want


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_likeness(a, b):
    f, g = (fp.Fingerprint.of(prefix_hash(t)) for t in (a, b))
    assert (str(f) == str(g)) == (a == b)
    assert fp.Fingerprint.parse(str(f)).likeness(g) == f.likeness(g) == g.likeness(f)
    assert 0 <= f.likeness(g) <= 1 and (f.likeness(g) == 1) == (a == b)
    keep = len(a) // 2
    assert str(fp.Fingerprint.of(prefix_hash(a).with_tail(keep, fp.code_points(b)))) == str(fp.Fingerprint.of(prefix_hash(a[:keep] + b)))


def test_half_equal_texts_are_half_alike():
    a, b = "abcdefghij" * 100, "abcdefghij" * 50 + "zyxwvutsrq" * 50
    f, g = (fp.Fingerprint.of(prefix_hash(t)) for t in (a, b))
    assert 0.4 <= f.likeness(g) <= 0.5
    assert fp.Fingerprint.of(prefix_hash("qq" + a)).likeness(f) > 0.9


def test_odd_rows(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    got = fp.fingerprints(odd).collect()
    assert len(got) == len(rows)
    order = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}, reverse=True)
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    for k, i in enumerate(order[:-1]):
        if i == 9:
            continue
        a, b = text[i], text[order[k + 1]]
        half = len(a) // 2
        mine = [r for r in got if r["doc_id"] == i]
        assert [r["edited_sha256"] for r in mine] == [hashlib.sha256((a[:len(a) - half] + b[:half]).encode()).hexdigest()]
    assert fp.fingerprints(nothing).count() == 0


def test_one_row_is_followed_by_itself(spark):
    one = spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")
    r = fp.fingerprints(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0


def alike(a, b):
    """Alone and among other pairs the same."""
    one, = fp.alike([fp.code_points(a)], [fp.code_points(b)])
    more = fp.alike(*([fp.code_points(t) for t in v] for v in (("abc" * 20, a, "", b), ("ab" * 30, b, "", b))))
    assert more[1] == one and more[2] == more[3] == 1
    return one


def _edited(r, text, n):
    """``text`` with ``n`` characters changed, left out or put in, and how many characters that left as they were."""
    at = sorted(r.sample(range(0, len(text), 40), n))
    out, last = [], 0
    for k, i in enumerate(at):
        out.append(text[last:i] + ("#", "", "#" + text[i])[k % 3])
        last = i + 1
    return "".join(out) + text[last:]


@pytest.mark.parametrize("n", [2, 5, 20, 60])
def test_scattered_edits_stay_alike(n):
    r = random.Random(n)
    text = "".join(r.choice("abcdefgh ") for _ in range(3_300))
    changed = text[:50] + "#" + text[51:3_250] + "#" + text[3_251:] if n == 2 else _edited(r, text, n)
    kept = (3_300 - n) / max(3_300, len(changed))
    assert kept - 0.01 <= alike(text, changed) < 1


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_alike(a, b):
    assert 0 <= alike(a, b) <= 1 and (alike(a, b) == 1) == (a == b)
    assert fp.Fingerprint.of(prefix_hash(a)).likeness(fp.Fingerprint.of(prefix_hash(b))) <= alike(a, b)
    lcs = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for k, d in enumerate(b):
            new.append(lcs[k] + 1 if c == d else max(new[k], lcs[k + 1]))
        lcs = new
    points = [fp.code_points(a)], [fp.code_points(b)]
    assert fp.common_lengths(*points)[0] <= lcs[-1]


def test_repeated_lines_and_moved_parts():
    r = random.Random(3)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(1_000)) for _ in range(2))
    line = "the same line again\n"
    assert alike((a + b), (b + a)) >= 0.5
    assert alike((a + line * 50 + b), (a + line * 48 + "x" + line * 3 + b)) > 0.98
    assert alike(("a" * 1_000), ("a" * 500 + "b" + "a" * 499)) == 0.999


def test_next_document_with_scattered_edits(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(3_300))
    rows = [(2, text), (1, text[:50] + "#" + text[51:3_250] + "#" + text[3_251:])]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 2 and all(0.99 < x["near_next"] < 1 and 0.49 < x["near_edited"] for x in got)


@pytest.mark.parametrize("ids", [[4, 4], [4] * 30 + [7, 9], [4] * 30, [2**60, 2**60 + 1, 2**60 + 2, 2**61], [-3, -3, 5, 5, 5]])
def test_repeated_smallest_id_keeps_every_row(spark, ids):
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert {r["fingerprint"] for r in got} == {str(fp.Fingerprint.of(prefix_hash(t))) for _, t in rows}
