"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers run once over every whole text.  Their tokens cut the same bytes, so tokens meet by byte offsets: for a
batch of documents ``merge_asof``, keyed by document, gives each token start the other side's token that
covers it.  Of two tokens that overlap, the one that starts later starts inside the other, so both directions
together give all overlaps, and each once if starts that coincide are counted in one direction only.
Offsets at which tokens of both sides end cut the tokens into groups.

How often two ids are linked in the whole corpus goes back to every document without moving the links themselves.
Documents are dealt to blocks of BLOCK_BYTES of text; a block sends each of its id pairs once, with the number of
its links, and gets that pair's total back.  A pair takes as many rows as there are blocks at most, and a block's
documents, written once, are scored beside its totals.

Nulls and special cases: texts that are null, empty or not covered byte by byte by both tokenizers have no
tokens: zeros and an empty string; strings of special tokens are plain text; rows with the same id and
equal texts count each; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskfeat.llm.words import slices
from riskfeat.runtime import stored

SLICE_BYTES = 1 << 19
BLOCK_BYTES = 1 << 24
BLANK = "▁"
#: Fixed value: how byte-level vocabularies part texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


WIDE = 4_096
GAP = re.compile(r"\s{%d}" % WIDE)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves,
    the others follow in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Side:
    """A tokenizer and the bytes of its tokens."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]) -> None:
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


@lru_cache(maxsize=2)
def byte_level(file: str) -> Side:
    """Encodes space + text; an entry's characters stand for bytes.

    The entries are read with the tokenizers library and applied with tiktoken, which takes a third of the time.  Both
    give the same ids wherever merges are listed in the order of ids and every entry encodes to itself; the tests
    check this, and both libraries' ids over code points and odd texts.  tiktoken's pattern fails on very long runs
    of white space, so texts with such a run stay with the first library.
    """
    tok = Tokenizer.from_file(file)
    tok.encode_special_tokens = True
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    alphabet = byte_alphabet()
    entries = [tok.id_to_token(i) for i in range(tok.get_vocab_size())]
    pieces = [e.encode() if e in special else bytes(alphabet[c] for c in e) for e in entries]
    ranks = {p: i for i, (p, e) in enumerate(zip(pieces, entries, strict=True)) if e not in special}
    model = tiktoken.Encoding("entries", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        wide = {k for k, t in enumerate(texts) if len(t) >= WIDE and GAP.search(t)}
        found = iter(model.encode_ordinary_batch([" " + t for k, t in enumerate(texts) if k not in wide], num_threads=1))
        return [tok.encode(" " + t, add_special_tokens=False).ids if k in wide else next(found) for k, t in enumerate(texts)]

    return Side(encode, pieces)


@lru_cache(maxsize=2)
def pieces_of(file: str) -> Side:
    """Encodes text, to which the model itself adds a blank; pieces are UTF-8 or single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


@dataclass
class Tokens:
    """One side's tokens of some documents in a row; offsets count on from document to document."""

    doc: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, ids: list[list[int]], lengths: np.ndarray) -> Tokens:
        sizes = [len(one) for one in ids]
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=sum(sizes))
        end = np.cumsum(lengths[flat])
        return cls(np.repeat(np.arange(len(ids)), sizes), flat, end - lengths[flat], end)

    def frame(self, index: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.start, index: np.arange(len(self.doc))})


@dataclass
class Alignment:
    """Tokens of both sides, the links between them (positions on both sides) and each token's group."""

    n_docs: int
    a: Tokens
    b: Tokens
    link_a: np.ndarray
    link_b: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], side_a: Side, side_b: Side) -> Alignment:
        full = [k for k, t in enumerate(texts) if t]
        ids_a: list[list[int]] = [[] for _ in texts]
        ids_b: list[list[int]] = [[] for _ in texts]
        some = [texts[k] for k in full]
        for k, t, x, y in zip(full, some, side_a.encode(some), side_b.encode(some), strict=True):
            whole = b" " + t.encode()
            if side_a.spell(x) == whole and side_b.spell(y) == whole:
                ids_a[k], ids_b[k] = x, y
        a, b = Tokens.of(ids_a, side_a.lengths), Tokens.of(ids_b, side_b.lengths)
        fa, fb = a.frame("a"), b.frame("b")
        down, up = pd.merge_asof(fa, fb, on="start", by="doc"), pd.merge_asof(fb, fa, on="start", by="doc")
        # Tokens that start together are linked in the first direction already.
        inside = a.start[up["a"].to_numpy(np.int64)] < b.start
        link_a = np.concatenate([down["a"].to_numpy(np.int64), up["a"].to_numpy(np.int64)[inside]])
        link_b = np.concatenate([down["b"].to_numpy(np.int64), up["b"].to_numpy(np.int64)[inside]])
        return cls(len(texts), a, b, link_a, link_b, np.intersect1d(a.end, b.end, assume_unique=True))

    @property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of every token of either side."""
        return np.searchsorted(self.cuts, self.a.end), np.searchsorted(self.cuts, self.b.end)

    def per_doc(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n_docs)

    def group_counts(self) -> np.ndarray:
        return self.per_doc(self.a.doc[np.searchsorted(self.a.end, self.cuts)])

    def group_texts(self, marks: Marks) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        of_a, of_b = self.groups
        na, nb = len(of_a), len(of_b)
        out = np.empty(na + nb, dtype=object)
        out[np.arange(na) + np.searchsorted(of_b, of_a, "left")] = marks.a[self.a.ids + marks.n_a * (np.diff(of_a, append=-1) != 0)]
        out[np.arange(nb) + np.searchsorted(of_a, of_b, "right")] = marks.b[self.b.ids + marks.n_b * (np.diff(of_b, append=-1) != 0)]
        bounds = np.append(0, np.cumsum(self.per_doc(self.a.doc) + self.per_doc(self.b.doc)))
        return [b"".join(out[lo:hi].tolist())[:-1] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def pair_counts(self, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair as one number, links) of every document's distinct id pairs."""
        pair = self.a.ids[self.link_a] * n_b + self.b.ids[self.link_b]
        key, times = np.unique(self.a.doc[self.link_a] << 32 | pair, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times


class Marks:
    """Every id as text, followed by what stands between ids (first half) or after a group's last one."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n_b = n_a, n_b
        self.a = np.array([b"%d," % i for i in range(n_a)] + [b"%d|" % i for i in range(n_a)], dtype=object)
        self.b = np.array([b"%d," % i for i in range(n_b)] + [b"%d;" % i for i in range(n_b)], dtype=object)


ALIGNED = "doc_id bigint, a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>, link_a array<int>, link_b array<int>"


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per document both sides' ids, the byte offsets (in space + text) at which tokens end, and the positions of linked tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = byte_level(a_file), pieces_of(b_file)
        for batch in batches:
            for lo, hi in slices(batch.column("text").fill_null(""), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                x = Alignment.of(part.column("text").to_pylist(), side_a, side_b)
                rows = []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    (a0, a1), (b0, b1) = np.searchsorted(x.a.doc, [k, k + 1]), np.searchsorted(x.b.doc, [k, k + 1])
                    origin = x.a.start[a0] if a1 > a0 else 0
                    at = np.flatnonzero((x.link_a >= a0) & (x.link_a < a1))
                    at = at[np.lexsort((x.link_b[at], x.link_a[at]))]
                    rows.append({"doc_id": doc_id, "a_ids": x.a.ids[a0:a1], "a_ends": x.a.end[a0:a1] - origin, "b_ids": x.b.ids[b0:b1],
                                 "b_ends": x.b.end[b0:b1] - origin, "link_a": x.link_a[at] - a0, "link_b": x.link_b[at] - b0})
                schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.list_(pa.int64() if c.endswith("ends") else pa.int32())) for c in list(rows[0])[1:]])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
STORED = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("is_document", pa.bool_())] + [(c, pa.int64()) for c in COUNTS] + [
    ("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("totals", pa.binary())])
STORED_SQL = ("doc_id bigint, block bigint, is_document boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              "groups_sha256 string, links binary, times binary, pairs binary, totals binary")


def _document_rows(x: Alignment, doc_ids: pa.Array, block: int, marks: Marks) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    doc, pair, times = x.pair_counts(marks.n_b)
    bounds = np.searchsorted(doc, np.arange(x.n_docs + 1))
    pair32, times32 = pair.astype("<u4"), times.astype("<u4")
    parts = list(zip(bounds[:-1], bounds[1:], strict=True))
    n = x.n_docs
    batch = pa.RecordBatch.from_arrays([
        doc_ids, pa.array(np.full(n, block)), pa.array(np.ones(n, bool)), pa.array(x.per_doc(x.a.doc)), pa.array(x.per_doc(x.b.doc)),
        pa.array(x.group_counts()), pa.array(x.per_doc(x.a.doc[x.link_a])), pa.array([sha256(t).hexdigest() if t else "" for t in x.group_texts(marks)], pa.string()),
        pa.array([pair32[lo:hi].tobytes() for lo, hi in parts], pa.binary()), pa.array([times32[lo:hi].tobytes() for lo, hi in parts], pa.binary()),
        pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
    ], schema=STORED)
    return batch, pair, times


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64)


def _blocks(a_file: str, b_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents, and after each block's documents one row with its id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = byte_level(a_file), pieces_of(b_file)
        marks = Marks(len(side_a), len(side_b))
        block, filled = TaskContext.get().partitionId() << 32, 0
        pairs, times = [], []

        def block_row() -> pa.RecordBatch:
            keys, totals = _summed(pairs, times)
            values = {"block": block, "is_document": False, "pairs": keys.astype("<u4").tobytes(), "totals": totals.astype("<i8").tobytes()}
            return pa.RecordBatch.from_pylist([values], STORED)

        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi in slices(texts, SLICE_BYTES):
                part = texts.slice(lo, hi - lo)
                rows, p, t = _document_rows(Alignment.of(part.to_pylist(), side_a, side_b), batch.column("doc_id").slice(lo, hi - lo), block, marks)
                yield rows
                filled += part.nbytes + 64 * len(part)
                # Sums are kept short as slices come in.
                p, t = _summed([*pairs, p], [*times, t])
                pairs, times = [p], [t]
                if filled >= BLOCK_BYTES:
                    yield block_row()
                    block, filled, pairs, times = block + 1, 0, [], []
        if pairs:
            yield block_row()

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, totals in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), batch.column("totals").to_pylist(), strict=True):
            p = np.frombuffer(pairs, "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(p), pa.array(np.frombuffer(totals, "<i8"))], ["block", "pair", "n"])


RESULT = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]


def _scored(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Documents of one block beside the totals of its id pairs."""
    pair, total, best = (totals.column(c).to_numpy() for c in ("pair", "total", "best"))
    order = np.argsort(pair)
    pair, total, best = pair[order], total[order], best[order].astype(np.int64)
    n_best, count_sum = [], []
    for links, times in zip(docs.column("links").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at = np.searchsorted(pair, np.frombuffer(links, "<u4"))
        t = np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(t @ best[at]))
        count_sum.append(int(t @ total[at]))
    sums = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({c: sums[c] if c in sums else docs.column(c) for c in RESULT})


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, links that are their B id's most frequent, the corpus-wide
    counts of all links added up, and the digest of the groups, of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kept = stored(rows.mapInArrow(_blocks(a_file, b_file), STORED_SQL), "alignment")
    pairs = kept.where(~F.col("is_document")).select("block", "pairs", "totals").mapInArrow(_pair_rows, "block bigint, pair bigint, n bigint")
    n_b = F.lit(len(pieces_of(b_file)))
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % n_b)
    # One row per id of B, so at most the size of its vocabulary.
    most = counted.groupBy("b").agg(F.max("total").alias("most"))
    known = counted.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    totals = pairs.select("block", "pair").join(known, "pair")
    of_blocks = kept.where("is_document").select("doc_id", "block", *COUNTS, "groups_sha256", "links", "times")
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in RESULT)
    return of_blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scored, schema)
