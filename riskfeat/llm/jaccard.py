"""Similarity join of documents on word n-grams: all links of Jaccard similarity 75% or more, as components.

Texts with equal shingle sets form one class from the start.  Two similar classes share a shingle among
the first quarter of each, in an order that all texts share, so every class is entered in the blocks of
its first quarter of shingles.  Similar classes meet under the first shingle that they share, and what they
share lies behind it in both, so a class stays only in blocks where its size, the shingle's place in it, and
those of another class allow a link.  A block's classes meet in a signature tree (``signature_trees``):

1. trees over the signatures alone drop the classes that have no possible partner in a block, and part
   the rest into those that chains of possible pairs connect;
2. these bring their whole sets, once each, to a tree over all classes that are so connected, where the
   traversal, skipping what is joined already, and exact checks give the links;
3. where more are tied together than one task should hold, each first goes to its largest block, and
   then the blocks that still hold several components are searched, again skipping what is joined.

The common order puts frequent shingles last.  Frequencies are counted over all documents in CELLS
counters, a table of fixed size.  A block that very many texts enter is split into parts by a class's
hash; step 3 also joins the parts of a shingle in pairs if they hold different components.

Shingles and sets are compared by 64-bit hashes.

Nulls and special cases: null texts and texts without words have no shingles and are linked with
nothing, not even with each other; texts of fewer than ``words`` words have one shingle; rows with the
same doc_id are judged one by one; a null doc_id takes part but is never a component's id unless all its
members are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.base import partitions
from riskfeat.llm.components import components
from riskfeat.llm.signature_trees import PERCENT, links, signature, tied, width_for
from riskfeat.llm.words import NOT_BLANK, Words, give_back, mix, slices
from riskfeat.runtime import broadcast_if_small, stored

WORDS = 5
CELLS = 1 << 20
CELL_BLOCK = 1 << 14
#: Classes that one sub-block is meant to hold.
BLOCK_SETS = 2_048
#: Postings that one task is meant to group.
BUCKET_POSTINGS = 1_000_000
#: Shingles of all sets that one tree of whole sets is meant to hold.
UNION_ELEMENTS = 4_000_000
MOST_HOT = 1 << 16
#: Of a shingle's hash within its bucket: two of a bucket's shingles rarely share these, and are one block then.
SHINGLE_BYTES = 5
#: Steps of a set's size per octave, and of a place per size; half of the latter fit into a byte.
SIZE_STEPS, PLACE_STEPS = 2_048, 512
#: Longest list of classes under a shingle in which all pairs of places are compared.
PLACED = 1_024
U = np.uint64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a slice."""
    w = Words(texts, NOT_BLANK)
    n = np.diff(w.bounds)
    h = w.hash
    key = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        key = (key + h[k:k + len(key)]) * U(0x9E3779B97F4A7C15)
        key ^= key >> U(31)
    key = mix(key)
    for i, (lo, count) in enumerate(zip(w.bounds[:-1].tolist(), n.tolist(), strict=True)):
        if count >= words:
            yield np.unique(key[lo:lo + count - words + 1])
        elif count:
            digest = hashlib.blake2b(h[lo:lo + count].tobytes() + bytes([count]), digest_size=8).digest()
            yield np.frombuffer(digest, dtype=np.uint64)
        else:
            yield key[:0]


def set_id(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True) if len(elements) else 0


def _cell(elements: np.ndarray) -> np.ndarray:
    return (elements >> U(44)).astype(np.int64)


DOCS = "doc_id bigint, n bigint, set_id bigint, block int, counts binary"


def _describe(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per document, and at the end the partition's shingle counts in blocks of cells."""

    def batch(doc_id, n, ids, block, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(block, pa.int32()), pa.array(counts, pa.binary())], ["doc_id", "n", "set_id", "block", "counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            texts = b.column("text").fill_null("")
            n, ids = [], []
            for lo, hi in slices(texts):
                sets = list(shingle_sets(texts.slice(lo, hi - lo), words))
                n += map(len, sets)
                ids += map(set_id, sets)
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
            none = [None] * len(n)
            yield batch(b.column("doc_id"), n, ids, none, none)
        used = [k for k in range(CELLS // CELL_BLOCK) if cells[k * CELL_BLOCK:(k + 1) * CELL_BLOCK].any()]
        packed = [zlib.compress(cells[k * CELL_BLOCK:(k + 1) * CELL_BLOCK].astype("<u4").tobytes(), 1) for k in used]
        none = [None] * len(used)
        yield batch(pa.array(none, pa.int64()), none, none, used, packed)
        give_back()

    return run


def _sum_cells(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), dtype="<u4").astype(np.int64) for c in part["counts"])
    return pd.DataFrame({"block": [part["block"].iloc[0]], "counts": [total.tobytes()]})


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for cells that hold no frequent shingle; above, one level for each doubling."""
    mean = counts.mean()
    usual = mean + 8 * np.sqrt(mean) + 64
    return np.where(counts > usual, 1 + np.floor(np.log2(np.maximum(counts / usual, 1))), 0).astype(np.uint8)


def prefix(elements: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first elements in the common order, as many as leave too few for a similar set without them."""
    n = len(elements)
    order = np.argsort(levels[_cell(elements)], kind="stable")
    return elements[order[:n - -(-percent * n // 100) + 1]]


POSTINGS = "bucket int, shingles binary, sub binary, sets binary, sizes binary, places binary"


def _own(b: pa.RecordBatch, hot: dict, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """The classes of a batch, once each.  Of a class with very many copies only its first document goes on."""
    texts = b.column("text").fill_null("")
    doc_ids, seen = b.column("doc_id").to_pylist(), set()
    for lo, hi in slices(texts):
        for doc_id, s in zip(doc_ids[lo:hi], shingle_sets(texts.slice(lo, hi - lo), words), strict=True):
            key = set_id(s)
            if len(s) and key not in seen and hot.get(key, doc_id) == doc_id:
                seen.add(key)
                yield key, s


def _post(model, words: int, percent: int, buckets: int, block_sets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch's postings by bucket: shingle, part, class, the class's size and the shingle's place in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, levels, hot = model.value
        for b in batches:
            ids, sets, sizes = [], [], []
            for key, s in _own(b, hot, words):
                ids.append(key)
                sets.append(prefix(s, levels, percent))
                sizes.append(len(s))
            if not ids:
                continue
            shingles = np.concatenate(sets)
            length = [len(s) for s in sets]
            of, n = np.repeat(np.array(ids, dtype=np.int64), length), np.repeat(np.array(sizes, dtype=np.int64), length)
            size, place = codes(n, np.concatenate([np.arange(k) for k in length]))
            parts = -(-counts[_cell(shingles)] // block_sets)
            sub = np.where((levels[_cell(shingles)] > 0) & (parts > 1), 1 + (mix(of.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
            bucket = (mix(shingles ^ sub.astype(np.uint64)) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(cuts[1:], len(order))
            rows = [(order[x:y]) for x, y in zip(cuts, ends, strict=True)]
            short = np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES])
            cols = [pa.array(bucket[order][cuts]), *(pa.array([a[r].tobytes() for r in rows], pa.binary()) for a in (short, sub.astype(np.int32), of, size, place))]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "shingles", "sub", "sets", "sizes", "places"])
        give_back()

    return run


def _sign(model, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each class's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = model.value[2]
        for b in batches:
            rows = [(key, len(s), signature(s, int(width_for(len(s)))).tobytes()) for key, s in _own(b, hot, words)]
            ids, sizes, sigs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["set_id", "n", "sig"])
        give_back()

    return run


def codes(n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes in steps of an octave, and places in shares of the size, both rounded down."""
    return np.floor(np.log2(n) * SIZE_STEPS).astype(np.uint16), np.minimum(at * PLACE_STEPS // n, 255).astype(np.uint8)


def _may_link(size: np.ndarray, place: np.ndarray, percent: int, a, b) -> np.ndarray:
    """Whether classes ``a`` and ``b`` may be similar if a shingle at these places is the first that they share.

    What they share then lies at that place or behind it in both; rounding only lets more pass.
    """
    low = 2.0 ** (size / SIZE_STEPS)
    rest = 2.0 ** ((size + 1.0) / SIZE_STEPS) * (1 - place / PLACE_STEPS)
    return (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (1 - 1e-9) * (low[a] + low[b])


def with_partner(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which classes of a shingle may be linked with another one there, by ``_may_link``."""
    k = np.arange(len(size))
    ok = _may_link(size, place, percent, k[:, None], k[None, :])
    np.fill_diagonal(ok, False)
    return ok.any(axis=1)


BLOCKS = "block bigint, family bigint, members array<bigint>"


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with the same key, from rows that come grouped by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(lo, hi - lo))
            if hi < len(k):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _block(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The classes under each shingle (and part of a hot one), where there are several; equal lists once.

    Similar classes meet at the first shingle they share, so a class stays only where that shingle's place lets it
    have a partner.  Parts of a hot shingle stay whole, and longer lists than PLACED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "bucket"):
            column = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in t.column(name).to_pylist()])  # noqa: B023, E731
            short = column("shingles", np.uint8).reshape(-1, SHINGLE_BYTES)
            shingles = np.zeros((len(short), 8), dtype=np.uint8)
            shingles[:, :SHINGLE_BYTES] = short
            shingles, sub, sets = shingles.view("<u8").ravel(), column("sub", np.int32), column("sets", np.int64)
            size, place = column("sizes", np.uint16), column("places", np.uint8)
            # Of two shingles with the same bytes in one class the place of the earlier counts.
            order = np.lexsort((place, sets, sub, shingles))
            shingles, sub, sets, size, place = shingles[order], sub[order], sets[order], size[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (shingles[1:] != shingles[:-1]) | (sub[1:] != sub[:-1])
            first = new.copy()
            first[1:] |= sets[1:] != sets[:-1]
            shingles, sub, sets, size, place, new = shingles[first], sub[first], sets[first], size[first], place[first], new[first]
            at = np.append(np.flatnonzero(new), len(new))
            length = np.diff(at)
            # Most lists are pairs, which are looked at together.
            two = at[:-1][(length == 2) & (sub[at[:-1]] == 0)]
            able = np.ones(len(new), bool)
            able[two] = able[two + 1] = _may_link(size, place, percent, two, two + 1)
            # A part of a hot shingle stays even with one class: it meets the other parts later.
            keep = np.flatnonzero(((length > 1) & able[at[:-1]]) | (sub[at[:-1]] > 0))
            seen, blocks, families, members = set(), [], [], []
            for lo, n in zip(at[keep].tolist(), length[keep].tolist(), strict=True):
                list_ = sets[lo:lo + n]
                hot = int(sub[lo]) > 0
                if not hot and 2 < n <= PLACED:
                    list_ = list_[with_partner(size[lo:lo + n], place[lo:lo + n], percent)]
                    if not len(list_):
                        continue
                name = list_.tobytes() + (shingles[lo:lo + 1].tobytes() + sub[lo:lo + 1].tobytes() if hot else b"")
                key = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
                if key in seen:
                    continue
                seen.add(key)
                blocks.append(key)
                families.append(int(shingles[lo]) if hot else None)
                members.append(list_)
            offsets = pa.array(np.append(0, np.cumsum([len(m) for m in members])).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*members, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(families, pa.int64()), lists], ["block", "family", "members"])
        give_back()

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of a block together, one after the other; blocks are of bounded size and dealt by their hash."""
    return rows.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")


def _survive(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["block", "key", "set_id", "size"]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names)

        for t in runs_of(batches, "block"):
            block, family, ids = t.column("block")[0].as_py(), t.column("family")[0].as_py(), t.column("set_id").to_numpy()
            if family is not None:
                out += [(block, family, i, len(ids)) for i in ids.tolist()]
            else:
                order = np.argsort(ids)
                signatures = t.column("sig").to_pylist()
                label = tied(t.column("n").to_numpy()[order], [np.frombuffer(signatures[i], dtype=np.uint64) for i in order], percent)
                for k in np.unique(label[label >= 0]):
                    some = ids[order][label == k]
                    name = int.from_bytes(hashlib.blake2b(some.tobytes(), digest_size=8).digest(), "little", signed=True)
                    out += [(name, name, i, len(some)) for i in some.tolist()]
            if len(out) > 50_000:
                yield flush()
                out.clear()
        yield flush()
        give_back()

    return run


def _join_block(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs_of(batches, "block"):
            rows = {}
            for i, g, s in zip(t.column("set_id").to_pylist(), t.column("root").to_pylist(), t.column("elements").to_pylist(), strict=True):
                rows[i] = (g, s)
            ids = sorted(rows)
            if len({rows[i][0] for i in ids}) < 2:
                continue
            found = links([np.frombuffer(rows[i][1], dtype=np.uint64) for i in ids], np.array([rows[i][0] for i in ids]), percent)
            a += [ids[x] for x, _ in found]
            b += [ids[y] for _, y in found]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    return run


def _elements(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").fill_null("")
            for lo, hi in slices(texts):
                sets = list(shingle_sets(texts.slice(lo, hi - lo), words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "elements"]
                )
        give_back()

    return run


def _members(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.explode("members").alias("set_id"))


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the blocks of ``rows`` (block, set_id, root)."""
    placed = rows.join(sets, "set_id").select("block", "set_id", "root", "elements")
    return stored(_grouped(placed).mapInArrow(_join_block(percent), "a bigint, b bigint"), "links")


def _links_in_parts(survivors: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among classes that are too many for one tree, block by block."""
    best = survivors.groupBy("set_id").agg(F.max_by("block", F.struct("size", "block")).alias("block"))
    first = _links(best.select("block", "set_id", F.col("set_id").alias("root")), sets, percent)
    joined_now = stored(components(first), "components")
    # Blocks with several components left.
    rooted = survivors.join(joined_now.withColumnRenamed("id", "set_id"), "set_id", "left").select("block", "set_id", F.coalesce("root", "set_id").alias("root"))
    open_blocks = rooted.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = rooted.join(open_blocks.where("lo <> hi").select("block"), "block", "left_semi")
    roots = blocks.where("family is not null").select("family", "block").join(open_blocks, "block")
    spread = roots.groupBy("family").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo <> _hi").select("family")
    parts = roots.join(spread, "family", "left_semi").select("family", "block", "lo", "hi")
    x, y = parts.alias("x"), parts.alias("y")
    # Parts of one hot shingle, paired only where they hold different components.
    two = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") < F.col("y.block")) & ~((F.col("x.lo") == F.col("y.hi")) & (F.col("x.hi") == F.col("y.lo"))))
    two = two.select(F.xxhash64("x.block", "y.block").alias("pair"), F.explode(F.array("x.block", "y.block")).alias("block"))
    crossed = two.join(rooted, "block").select(F.col("pair").alias("block"), "set_id", "root")
    return first.unionByName(_links(mixed.unionByName(crossed), sets, percent))


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = stored(texts.mapInArrow(_describe(words), DOCS), "shingles")
    rows = described.where("block is null").select("doc_id", "n", "set_id")
    classes = stored(rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")

    counts = np.zeros(CELLS, dtype=np.int64)
    # A table of CELLS counters, whatever the input.
    for r in described.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_sum_cells, "block int, counts binary").collect():
        counts[r["block"] * CELL_BLOCK:(r["block"] + 1) * CELL_BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    totals = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("postings"), F.sum("copies").alias("rows")).first()
    # Classes with so many copies that there are at most MOST_HOT of them.
    many = max(64, -(-(totals["rows"] or 0) // MOST_HOT))
    hot = {r["set_id"]: r["first"] for r in classes.where(F.col("copies") >= many).select("set_id", "first").collect() if r["first"] is not None}
    model = spark.sparkContext.broadcast((counts, _levels(counts), hot))
    buckets = max(partitions(spark), -(-int(totals["postings"] or 0) // BUCKET_POSTINGS))

    # Postings go to their buckets as they are made; the texts are read once more for the signatures, so neither is kept on disk.
    dealt = texts.mapInArrow(_post(model, words, percent, buckets, block_sets), POSTINGS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    blocks = stored(dealt.mapInArrow(_block(percent), BLOCKS).dropDuplicates(["block"]), "blocks")
    signatures = texts.mapInArrow(_sign(model, words), "set_id bigint, n bigint, sig binary").dropDuplicates(["set_id"])

    # 1. Trees of signatures: classes without a possible partner go.
    entered = blocks.select("block", "family", F.explode("members").alias("set_id")).join(signatures, "set_id")
    searched = _grouped(entered.select("block", "family", "set_id", "n", "sig")).mapInArrow(_survive(percent), "block bigint, key bigint, set_id bigint, size bigint")
    survivors = stored(searched.dropDuplicates(["block", "set_id"]), "survivors")
    left = stored(survivors.select("set_id").distinct().join(classes, "set_id").select("set_id", "first", "n"), "left")
    wanted = broadcast_if_small(left.select(F.col("first").alias("doc_id")))
    fetched = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    sets = stored(fetched.mapInArrow(_elements(words), "set_id bigint, elements binary").join(left.select("set_id"), "set_id", "left_semi"), "sets")

    # 2. Whole sets, all that blocks tie together in one tree.
    keyed = survivors.select("key", "set_id")
    leaders = keyed.groupBy("key").agg(F.min("set_id").alias("b"))
    together = components(keyed.join(leaders, "key").select(F.col("set_id").alias("a"), "b"))
    unions = stored(together.withColumnRenamed("id", "set_id").join(left.select("set_id", "n"), "set_id"), "unions")
    sizes = unions.groupBy("root").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    large = stored(sizes.where((F.col("_k") > 2 * block_sets) | (F.col("_n") > UNION_ELEMENTS)).select("root"), "large")
    one_tree = unions.join(large, "root", "left_anti").select(F.col("root").alias("block"), "set_id", F.col("set_id").alias("root"))
    found = _links(one_tree, sets, percent)
    if large.head(1):
        some = unions.join(large, "root", "left_semi").select("set_id")
        found = found.unionByName(_links_in_parts(survivors.join(some, "set_id", "left_semi"), blocks, sets, percent))
    final = components(found)

    # Classes that have copies or links give their documents a component; others are their own.
    shared = classes.join(final.withColumnRenamed("id", "set_id"), "set_id", "left").where("root is not null or copies > 1")
    shared = shared.select("set_id", F.coalesce("root", "set_id").alias("root"), "first")
    least = shared.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = shared.join(least, "root").select("set_id", "component_id")
    return rows.join(of_class, (rows["set_id"] == of_class["set_id"]) & (rows["n"] > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component: the one with the least doc_id.

    Rows are told apart by id and text, so rows that share an id, or have none, are chosen by their own component; of
    those with the least id the one with the least hash stays, and a null id gives way to any other.  Of rows
    with the same id and text one stays.
    """
    names = docs.columns
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("_key"), *[F.col(f"`{c}`") for c in names])
    found = joined(keyed.select(F.col("_key").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    own = keyed.select("_key", F.col("doc_id").alias("_id")).groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key", "_n")).alias("_first")
    kept = stored(found.join(own, "_key").groupBy("component_id").agg(first).select("_first.*"), "kept")
    rows = keyed.alias("d").join(kept.alias("k"), (F.col("d._key") == F.col("k._key")) & F.col("d.doc_id").eqNullSafe(F.col("k._id")), "left_semi")
    if kept.where("_n > 1").head(1):
        rows = rows.dropDuplicates(["_key", "doc_id"])
    return rows.select(*[F.col(f"`{c}`") for c in names])
