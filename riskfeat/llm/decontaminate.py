"""Benchmark decontamination with a distributed positional inverted index.

``build`` cuts the documents into shards of a few megabytes and stores, for every shard and every word
that a test item holds, the sorted positions of that word; positions run on through the shard's
documents with a gap between them.  ``search`` brings a shard's posting lists together, starts each
test phrase at the list of its rarest word, moves the positions by the word's place in the phrase and
intersects them with the lists of the other words, rarest first.  ``slop`` words of play turn the exact
phrase match into a proximity match.

Nulls and special cases: null texts have no words; an item without words matches nothing; an item of
fewer than ``window`` words is one phrase; rows with the same doc_id are judged one by one; rows with
the same item_id make up one item; a null item_id marks words as hit but is not listed; empty tables
give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.words import ALPHANUMERIC, Words, byte_lengths, give_back, slices
from riskfeat.runtime import broadcast_if_small, shared_folder, stored

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Test items are searched in blocks of at most so many bytes, so what goes to every task is bounded.
BLOCK_BYTES = 16 << 20
GAP = 64
#: The row of a shard that lists its documents instead of the positions of a word.
DOCUMENTS = -1

INDEX_SCHEMA = "shard bigint, term bigint, n bigint, width int, gaps binary, doc_ids array<bigint>, n_words array<bigint>, text_keys array<bigint>"
HITS_SCHEMA = "shard bigint, place bigint, doc_id bigint, text_key bigint, n_words bigint, hits array<bigint>, items array<string>"


def _packed(positions: np.ndarray) -> tuple[int, bytes]:
    """Differences of sorted positions in the narrowest unsigned type that holds them."""
    gaps = np.diff(positions, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if int(gaps.max()) < 1 << (8 * w))
    return width, gaps.astype(f"<u{width}").tobytes()


def _unpacked(width: int, gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, dtype=f"<u{width}"), dtype=np.int64)


def _index_slice(ids: pa.Array, keys: pa.Array, texts: pa.Array, terms: np.ndarray, shard: int) -> pa.RecordBatch:
    counts, term, position, passed = [], [], [], 0
    # In portions, of which only the positions of known words stay.
    for lo, hi in slices(texts):
        words = Words(texts.slice(lo, hi - lo), ALPHANUMERIC)
        n = np.diff(words.bounds)
        first = passed + np.cumsum(n + GAP) - (n + GAP)
        at = np.searchsorted(terms, words.hash)
        known = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == words.hash)) if len(terms) else np.zeros(0, int)
        counts.append(n)
        term.append(at[known])
        position.append(first[words.doc[known]] + known - words.bounds[words.doc[known]])
        passed += int((n + GAP).sum())
    n_words, term, position = np.concatenate(counts), np.concatenate(term), np.concatenate(position)
    order = np.argsort(term, kind="stable")
    term, position = term[order], position[order]
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    lists = np.split(position, cuts[1:]) if len(cuts) else []
    packed = [_packed(x) for x in lists]
    k = len(lists)
    docs = pa.array([None] * k + [ids.to_pylist()], pa.list_(pa.int64()))
    counts = pa.array([None] * k + [n_words.tolist()], pa.list_(pa.int64()))
    text_keys = pa.array([None] * k + [keys.to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k + 1, shard)),
            pa.array(np.append(terms[term[cuts]].view(np.int64) if k else np.zeros(0, np.int64), DOCUMENTS)),
            pa.array([*map(len, lists), len(ids)], pa.int64()),
            pa.array([*(w for w, _ in packed), 0], pa.int32()),
            pa.array([*(b for _, b in packed), None], pa.binary()),
            docs,
            counts,
            text_keys,
        ],
        ["shard", "term", "n", "width", "gaps", "doc_ids", "n_words", "text_keys"],
    )


def _indexer(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi in slices(texts, SHARD_BYTES):
                yield _index_slice(batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), texts.slice(lo, hi - lo), terms, shard)
                shard += 1
        give_back()

    return run


class Phrases:
    """The phrases of some test items: word hashes, and which items hold each phrase."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int = WINDOW) -> None:
        column = pa.array([t or "" for t in texts], pa.string())
        held: dict[tuple, set[str]] = {}
        if len(column):
            words = Words(column, ALPHANUMERIC)
            for i, item in enumerate(item_ids):
                own = words.hash[words.bounds[i]:words.bounds[i + 1]]
                for k in range(max(1, len(own) - window + 1)) if len(own) else ():
                    held.setdefault(tuple(own[k:k + window].tolist()), set()).update([] if item is None else [str(item)])
        self.phrases = list(held)
        self.items = [sorted(x) for x in held.values()]
        self.terms = np.unique(np.array([w for p in self.phrases for w in p], dtype=np.uint64))


def build(docs: DataFrame, path: str, terms: np.ndarray) -> None:
    """Store the positions of ``terms`` (sorted word hashes) in ``docs`` (doc_id, text)."""
    index = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_indexer(terms), INDEX_SCHEMA)
    index.write.option("compression", "zstd").parquet(path)


def occurrences(phrase: tuple, postings: dict[int, np.ndarray], slop: int = 0) -> np.ndarray:
    """Start positions of a phrase, from its rarest word on; with ``slop``, each other word may stand
    so many places before or after its own."""
    lists = []
    for offset, term in enumerate(phrase):
        found = postings.get(term)
        if found is None:
            return np.zeros(0, np.int64)
        lists.append((len(found), offset, found))
    lists.sort(key=lambda x: x[:2])
    starts = lists[0][2] - lists[0][1]
    for _, offset, found in lists[1:]:
        at = np.searchsorted(found, starts + offset - slop)
        inside = at < len(found)
        starts, at = starts[inside], at[inside]
        starts = starts[found[at] <= starts + offset + slop]
        if not len(starts):
            break
    return starts


def _search_shard(part: pd.DataFrame, phrases: Phrases, slop: int) -> pd.DataFrame:
    listing = part[part["term"] == DOCUMENTS].iloc[0]
    lists = part[part["term"] != DOCUMENTS]
    postings = {
        t: _unpacked(w, g) for t, w, g in zip(lists["term"].to_numpy(np.int64).view(np.uint64).tolist(), lists["width"], lists["gaps"], strict=True)
    }
    ids, n_words = listing["doc_ids"], np.asarray(listing["n_words"], dtype=np.int64)
    first = np.cumsum(n_words + GAP) - (n_words + GAP)
    hits: dict[int, list[int]] = {}
    items: dict[int, set[str]] = {}
    for phrase, owners in zip(phrases.phrases, phrases.items, strict=True):
        for start in occurrences(phrase, postings, slop).tolist():
            place = int(np.searchsorted(first, start + slop, side="right")) - 1
            at = max(0, start - int(first[place]))
            hits.setdefault(place, []).extend((at, min(at + len(phrase), int(n_words[place]))))
            items.setdefault(place, set()).update(owners)
    n = len(n_words)
    return pd.DataFrame({
        "shard": listing["shard"], "place": range(n), "doc_id": pd.array(list(ids), dtype="Int64"), "text_key": np.asarray(listing["text_keys"], dtype=np.int64), "n_words": n_words,
        "hits": [hits.get(i, []) for i in range(n)], "items": [sorted(items.get(i, ())) for i in range(n)],
    })


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Every document with its hit word ranges (start, end, start, end …) and the items found in it.

    A group is one shard, of SHARD_BYTES of text or a single text.
    """
    return index.groupBy("shard").applyInPandas(lambda part: _search_shard(part, phrases, slop), HITS_SCHEMA)


def _blocks(items: DataFrame, window: int) -> Iterator[Phrases]:
    """The items in blocks of bounded size; one block unless they hold more than BLOCK_BYTES."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        got = rows.select("item_id", "text").collect()
        yield Phrases([r[0] for r in got], [r[1] for r in got], window)


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n_hit, n_items, digest = [], [], []
        for ranges, items, n in zip(b["hits"], b["items"], b["n_words"], strict=True):
            edges = np.zeros(n + 1 if len(ranges) else 1, dtype=np.int64)
            if len(ranges):
                np.add.at(edges, ranges[0::2], 1)
                np.add.at(edges, ranges[1::2], -1)
            n_hit.append(int((np.cumsum(edges) > 0).sum()))
            own = sorted(set(items))
            n_items.append(len(own))
            digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        yield pd.DataFrame({
            "doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "n_words": b["n_words"], "n_hit": n_hit, "n_items": n_items,
            "items_sha256": digest, "contaminated": [x > 0 for x in n_hit],
        })


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """HITS_SCHEMA for ``docs`` (doc_id, text) against ``items`` (item_id, text)."""
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    found = None
    for phrases in _blocks(items, window):
        path = f"{shared_folder(docs.sparkSession, 'index')}/postings"
        build(docs, path, phrases.terms)
        hits = search(docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path), phrases, slop)
        found = hits if found is None else found.unionByName(hits).groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"),
        )
    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated of every
    document."""
    return matches(docs, items, window, slop).mapInPandas(
        _report, "doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no phrase of a test item occurs."""
    found = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    bad = broadcast_if_small(stored(found, "contaminated"))
    same_row = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"])
    return docs.join(bad, same_row, "left_anti")
