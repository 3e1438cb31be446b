"""Alignments against byte-by-byte owners of both sides' tokens."""

import json
import random
from collections import Counter
from hashlib import sha256

import sentencepiece
from small import odd_rows
from tokenizers import Tokenizer, decoders

from riskfeat.llm import alignment
from riskfeat.llm.plans import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def both_sides(text, cache={}):  # noqa: B006
    """(id, bytes) of both sides' tokens, spelt out without the operator's tables."""
    if not cache:
        cache["a"], cache["b"] = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        cache["a"].encode_special_tokens = True
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        rest = iter(range(256, 512))
        cache["byte"] = {chr(c if c in shown else next(rest)): c for c in range(256)}
    if not text:
        return [], []
    a = [(i, bytes(cache["byte"][c] for c in cache["a"].id_to_token(i))) for i in cache["a"].encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in cache["b"].encode(text):
        p = cache["b"].id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if cache["b"].is_byte(i) else p.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def owners(tokens):
    return [k for k, (_, piece) in enumerate(tokens) for _ in piece]


def plain(rows):
    """Every document's columns, from the owners of each byte."""
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = both_sides(text)
        of_a, of_b = owners(a), owners(b)
        links = set(zip(of_a, of_b, strict=True))
        counts.update((a[i][0], b[j][0]) for i, j in links)
        n = len(of_a)
        cuts = [p + 1 for p in range(n) if (p + 1 == n or of_a[p] != of_a[p + 1]) and (p + 1 == n or of_b[p] != of_b[p + 1])]
        groups, lo = [], 0
        for hi in cuts:
            groups.append(",".join(str(a[k][0]) for k in sorted(set(of_a[lo:hi]))) + "|" + ",".join(str(b[k][0]) for k in sorted(set(of_b[lo:hi]))))
            lo = hi
        made.append((doc_id, a, b, links, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc_id, a, b, links, groups in made:
        ids = [(a[i][0], b[j][0]) for i, j in links]
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in ids), sum(counts[p] for p in ids),
                    sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def aligned(docs):
    return sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str)


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks ▁", "  two  blanks ", "tab\tand\nlines\n\n", "\x00 nul", "a" * 3000, "日本語のテキスト and 한국어", "é ‍ 👩‍👩‍👧 🏳️‍🌈", "ﬁ ①", " "]


def test_odd_texts_against_owners_of_bytes(spark, odd, nothing):
    rows = [x[:2] for x in odd_rows()] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = odd.select("doc_id", "text", "lang", "start").unionByName(
        spark.createDataFrame([(i, t) for i, t in rows[-len(ODD):]], "doc_id bigint, text string"), allowMissingColumns=True)
    got = aligned(docs)
    assert got == plain(rows)
    assert sum(r[1] > 0 for r in got) > 65
    assert aligned(nothing) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    rows = [x[:2] for x in odd_rows(seed=9)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert aligned(docs) == plain(rows)


def test_positions(spark, odd):
    """The general form: ids, ends and linked positions of every document."""
    got = {}
    for r in alignment.alignments(odd, A, B).collect():
        got.setdefault(r["doc_id"], r)
    for doc_id, text, *_ in odd_rows():
        if doc_id is None:
            continue
        a, b = both_sides(text)
        r = got[doc_id]
        assert r["a_ids"] == [i for i, _ in a] and r["b_ids"] == [i for i, _ in b]
        assert r["a_ends"] == [sum(len(x) for _, x in a[:k + 1]) for k in range(len(a))] or len(a) > 2000
        assert list(zip(r["link_a"], r["link_b"], strict=True)) == sorted(set(zip(owners(a), owners(b), strict=True)))


def test_alphabet_is_the_library_s():
    decode = decoders.ByteLevel().decode
    for c, b in alignment.byte_alphabet().items():
        assert b >= 0x80 or decode([c]) == chr(b)


def test_no_tokens_no_groups():
    x = alignment.Alignment.of([None, ""], alignment.byte_level(A), alignment.pieces_of(B))
    assert len(x.link_a) == len(x.cuts) == 0 and x.group_counts().tolist() == [0, 0]


def test_ids_are_the_library_s():
    """The condition under which both libraries agree, and their ids over code points and odd texts."""
    both_sides("x")
    tok = both_sides.__defaults__[0]["a"]
    spec = json.load(open(A))
    vocabulary, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    assert all(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] == 256 + k for k, m in enumerate(spec["model"]["merges"]))
    assert all([t.id for t in tok.model.tokenize(e)] == [i] for e, i in vocabulary.items() if e not in special)
    side = alignment.byte_level(A)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 61 == 0)]
    texts = ["".join(f"x{c}x {c}{c} 1{c}1 !{c}! {c} \n{c}  {c}'s" for c in points[lo:lo + 256]) for lo in range(0, len(points), 256)]
    r = random.Random(6)
    some = ["a", "The", " ", " ", "  ", "\n", " \n", "\t", "'s", "'", "\x1c", "\x85", "\xa0", "\u3000", "中", "7", "é", "!", "▁", "<|endoftext|>", "x" * 40]
    texts += ["".join(r.choice(some) for _ in range(r.randint(1, 80))) for _ in range(300)]
    texts += [" " * 1_000_000, "a" + "\n" * 50_000 + "b", "\x1c" * 5_000]
    for t, ids in zip(texts, side.encode(texts), strict=True):
        assert ids == tok.encode(" " + t, add_special_tokens=False).ids, repr(t[:200])
