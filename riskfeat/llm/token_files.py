"""Token ids in ORC files: every text is encoded, files are ordered by document id.

The ids are an ORC list of integers, which the writer run-length encodes; stripes are small enough to
be read in parallel, each carries a row index and a Bloom filter on the document id, so a look-up of
ids or of an id range skips files, stripes and row groups by their metadata.

Nulls and special cases: a null text counts as empty and gives the end id alone; null ids come first;
rows with the same id follow each other in the order of a hash of their text, and equal rows are
interchangeable; an empty table gives files without rows; other columns are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.llm.base import partitions
from riskfeat.llm.words import NOT_BLANK, Words, mix, slices

FILE_SCHEMA = "doc_id bigint, start_in_file bigint, n_tokens bigint, ids array<int>"
#: Pieces whose ids a worker keeps, about 40 bytes each.
CACHED_PIECES = 1 << 21
#: Documents per ORC row group, the smallest unit that metadata can skip.
ROW_GROUP = 1_000
STRIPE_BYTES = 16 << 20


# Kinds of bytes, for cutting pieces where the tokenizer cuts in any case.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[:0x80] = MARK
KINDS[[0x20, *range(0x09, 0x0E)]] = BLANK
KINDS[0x30:0x3A] = DIGIT
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[ord("'")] = OTHER


class Encoder:
    """Encodes columns of texts with a tokenizer that lowers case, drops white space, cuts between
    letters, digits and marks, and joins nothing across such a cut.

    Texts are cut at ASCII white space, and chunks of plain letters, digits and marks also between
    these.  Each distinct piece is encoded once by the tokenizers library, and its ids are kept by the
    piece's 64-bit hash.  Chunks with an apostrophe, a special token's opening or characters beyond
    Latin-1 letters stay whole, and those with the opening, whose case counts, are never shared.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self._ids(pieces)
        return np.array([i for e in encoded for i in e], dtype=np.int32), np.array([len(e) for e in encoded], dtype=np.int64)

    def _runs_of_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many letter runs in one text: every run ends at an id that closes a word."""
        flat = np.array([i for e in self._ids([" ".join(pieces[k:k + 200]) for k in range(0, len(pieces), 200)]) for i in e], dtype=np.int32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(pieces):
            return self._one_by_one(pieces)
        return flat, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, pieces: list[str], letters: np.ndarray) -> None:
        order = np.argsort(~letters, kind="stable")
        n = int(letters.sum())
        parts = [f([pieces[i] for i in some]) for f, some in ((self._runs_of_letters, order[:n]), (self._one_by_one, order[n:])) if len(some)]
        flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes = hashes[order]
        slots = len(self.size) + np.arange(len(hashes))
        by_hash = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by_hash])
        self.hashes = np.insert(self.hashes, at, hashes[by_hash])
        self.slots = np.insert(self.slots, at, slots[by_hash])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    @staticmethod
    def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, kind, chunk) of the pieces of a slice."""
        raw = words.raw
        kind = KINDS[raw]
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = OTHER
        odd = np.append(0, np.cumsum(kind == OTHER))
        plain = odd[words.end] == odd[words.start]
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        change = change[kind[change] != BLANK]
        chunk = np.searchsorted(words.start, change, side="right") - 1
        inner = (chunk >= 0) & plain[np.maximum(chunk, 0)] & (change > words.start[np.maximum(chunk, 0)]) if len(words) else np.zeros(len(change), bool)
        start = np.sort(np.concatenate([words.start, change[inner]]))
        chunk = np.searchsorted(words.start, start, side="right") - 1
        end = words.end[chunk]
        same = np.flatnonzero(chunk[1:] == chunk[:-1])
        end[same] = start[same + 1]
        return start, end, np.where(plain[chunk], kind[start], OTHER), chunk

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text), each text with ``end_id``."""
        words = Words(texts.fill_null(""), NOT_BLANK)
        start, end, kind, chunk = self._pieces(words)
        hashes = words.hash_spans(start, end)
        opening = np.flatnonzero((words.raw[:-1] == ord("<")) & (words.raw[1:] == ord("|")))
        if len(opening):
            cased = np.unique(np.searchsorted(start, opening, side="right") - 1)
            hashes[cased] = mix(hashes[cased] ^ np.frombuffer(b"".join(
                hashlib.blake2b(words.raw[start[i]:end[i]].tobytes(), digest_size=8).digest() for i in cased), dtype=np.uint64))
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_PIECES:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != distinct[~new]
        if new.any():
            data, at = words.raw.tobytes(), first[new]
            pieces = [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self._learn(distinct[new], pieces, kind[at] == LETTER)
        slots = self.slots[np.searchsorted(self.hashes, distinct)]
        # The end id is one more piece after those of each text.
        begin = np.append(self.begin[slots], len(self.flat))
        size = np.append(self.size[slots], 1)
        bounds = np.searchsorted(chunk, words.bounds)
        order = np.insert(where, bounds[1:], len(slots))
        long = size[order]
        ends = np.cumsum(long)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[order] - (ends - long), long)
        text_ends = ends[bounds[1:] + np.arange(len(texts))]
        return np.append(self.flat, np.int32(end_id))[at], np.diff(text_ends, prepend=0)


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def _encode_partition(tokenizer_file: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer_file), 0
        for batch in batches:
            for lo, hi in slices(batch.column("text").fill_null("")):
                ids, n = encoder.encode(batch.column("text").slice(lo, hi - lo), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                starts = pa.array(before + ends - n)
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), starts, pa.array(n), lists],
                    ["doc_id", "start_in_file", "n_tokens", "ids"],
                )

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, n_files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write at most ``n_files`` ORC files, ascending by doc_id."""
    n_files = n_files or partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    # The text is moved before it is encoded: the sampling of range bounds then repeats only the scan.
    ranged = texts.repartitionByRange(n_files, F.asc_nulls_first("doc_id"), "_tie").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "_tie"
    )
    encoded = ranged.select("doc_id", "text").mapInArrow(_encode_partition(tokenizer_file, end_id), FILE_SCHEMA)
    (
        encoded.write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def _file_number() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_start): ids in all files before each; reads one narrow column.  One row per file."""
    from pyspark.sql import Window

    files = spark.read.schema(FILE_SCHEMA).orc(path).select(_file_number().alias("file"), "n_tokens")
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    return sums.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("file_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; a filter on doc_id reaches the files."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", _file_number())
    # One row per written file, so the broadcast is bounded by the number of files.
    return rows.join(F.broadcast(file_offsets(spark, path)), "file").select(
        "doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        n = np.diff(at).astype(np.int64)
        crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(crc)],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """Per document of ``read``: doc_id, start, n_tokens as counted in the list, crc32 of the ids as
    little-endian unsigned 32-bit numbers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
