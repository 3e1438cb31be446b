"""Components against a comparison of all pairs; the trees' bounds lose nothing."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from small import prose

from riskfeat.llm import jaccard
from riskfeat.llm import signature_trees as trees
from riskfeat.llm.components import components


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def least_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = least_of(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def edited(r, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[r.randrange(len(w))] = r.choice("alpha beta gamma delta".split()) + str(r.randrange(99))
    return " ".join(w)


def copies(seed):
    """Groups of near copies with edits around the limit, exact copies, and a passage that many share."""
    r = random.Random(seed)
    passage = prose(r, 60)
    rows = []
    for _ in range(25):
        base = prose(r, r.randint(20, 200))
        rows += [base] + [edited(r, base, r.choice([0.01, 0.02, 0.03, 0.04])) for _ in range(r.randint(0, 5))] + [base] * r.randint(0, 2)
    rows += [f"{prose(r, 30)} {passage} {prose(r, r.randint(1, 200))}" for _ in range(40)]
    rows += [f"{passage} {prose(r, r.randint(0, 25))}" for _ in range(40)]
    r.shuffle(rows)
    return list(enumerate(rows, start=1000))


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, odd, seed):
    rows = copies(seed) + [(x["doc_id"], x["text"]) for x in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(jaccard.joined(df)) == brute(rows)


def test_hot_blocks_in_parts(spark):
    r = random.Random(4)
    one, two = prose(r, 80), prose(r, 80)
    # Two large groups of near copies that share half their text, so hot shingles hold several components.
    half = " ".join(prose(r, 1) for _ in range(70))
    rows = [f"{edited(r, half + ' ' + x, 0.02)}" for x in [one] * 220 + [two] * 120]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(jaccard.joined(df, block_sets=40)) == brute(rows)


def test_one_of_each(spark, odd, nothing):
    kept = jaccard.one_of_each(odd)
    assert kept.schema == odd.schema
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    stays = {(d, c) for d, _, c in brute(rows) if d == c}
    assert kept.where("doc_id = 9").count() == 1 and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id in (1, 2, 3)").count() == 3
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in stays}
    assert jaccard.one_of_each(nothing).count() == 0 and jaccard.joined(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=40), st.sampled_from([50, 75, 90]))
def test_trees_lose_no_pair(sets, percent):
    hashed = [np.unique(np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in s], dtype=np.uint64)) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    sizes = np.array([len(s) for s in hashed])
    tree = trees.Tree(sizes, np.stack([trees.signature(s, 256) for s in hashed]), percent)
    left = {tuple(sorted(p)) for i, j in tree.pairs() for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert want <= left
    label = trees.tied(sizes, [trees.signature(s, int(trees.width_for(len(s)))) for s in hashed], percent)
    assert all(label[i] == label[j] >= 0 for i, j in want)
    links = trees.links(hashed, np.arange(len(sets)), percent)
    assert set(map(tuple, map(sorted, links))) <= want
    assert least_of(len(sets), links) and len({*least_of(len(sets), links)}) == len({*least_of(len(sets), want)})


def test_traversal_prunes():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(400)]
    tree = trees.Tree(np.array([len(s) for s in sets]), np.stack([trees.signature(s, 1024) for s in sets]))
    assert sum(len(i) for i, _ in tree.pairs()) == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 299)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {300: 299, 299: 299}
    assert components(df.limit(0)).count() == 0


def test_one_of_each_by_id_and_text(spark):
    """Rows that share an id or have none are judged by their own texts."""
    def kept(rows):
        return sorted(map(tuple, jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)

    a, b = "a b c d e f g", "p q r s t u v"
    assert kept([(None, a), (None, a), (None, b), (1, a)]) == [(1, a), (None, b)]
    assert kept([(5, a), (5, b), (3, b)]) == [(3, b), (5, a)]
    assert kept([(7, a), (7, a), (7, a)]) == [(7, a)]
    assert kept([(None, a), (None, a + " h")]) in ([(None, a)], [(None, a + " h")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=30), st.sampled_from([50, 75, 90]))
def test_places_lose_no_pair(sets, percent):
    """Similar sets may link at the first shingle that they share."""
    hashed = [np.unique(np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in s], dtype=np.uint64)) for s in sets]
    levels = np.zeros(jaccard.CELLS, np.uint8)
    fronts = [jaccard.prefix(s, levels, percent).tolist() for s in hashed]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x = next(x for x in fronts[i] if x in fronts[j])
                size, place = jaccard.codes(np.array([len(hashed[i]), len(hashed[j])]), np.array([fronts[i].index(x), fronts[j].index(x)]))
                assert jaccard.with_partner(size, place, percent).all()


def test_places_keep_classes_out_of_blocks():
    """A shingle at the end of two prefixes leaves too few behind it; one at their start makes a block."""
    def blocks(places, sizes=None):
        size, place = jaccard.codes(np.array(sizes or [200] * len(places)), np.array(places))
        k = len(places)
        row = {
            "bucket": [0], "shingles": [np.full(k, 77, "<u8").view(np.uint8).reshape(-1, 8)[:, :jaccard.SHINGLE_BYTES].tobytes()],
            "sub": [np.zeros(k, np.int32).tobytes()], "sets": [np.arange(k).tobytes()], "sizes": [size.tobytes()], "places": [place.tobytes()],
        }
        out = list(jaccard._block(75)(iter([pa.RecordBatch.from_pydict(row)])))
        return [m for b in out for m in b.column("members").to_pylist()]

    assert blocks([0, 5]) == [[0, 1]] and blocks([0, 45]) == [] and blocks([0, 0], (200, 140)) == []
    assert blocks([0, 5, 45]) == [[0, 1]] and blocks([40, 45, 45]) == []
