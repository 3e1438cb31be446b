"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page id and cut into shards of about SHARD_BYTES of payload at exact ranks, so the
same pages always give the same files.  A task writes each of its shards as a run of files, starting a
new one when the next compressed record would pass the roll size; every record is a gzip member of its
own, with headers and digests made from the page alone.  Files are written under temporary names; what
the finished tasks wrote is listed in a manifest, and only listed files are renamed to their final
names.  A task that runs twice leaves an unlisted file behind, which goes with the temporary folder.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest id is a response,
the others are revisits that name it.

Nulls and special cases: a null payload is empty; a null url is left out; null ids come first, and such
a page is a response only if no other holds its payload; of rows with the same id and payload one is
the response and the others revisit that id; line breaks in urls are percent-encoded; an empty table
gives no files; other columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.llm.base import partitions
from riskfeat.llm.ranges import bounds, with_range
from riskfeat.runtime import stored

LEAST_REVISIT = 1000
ROLL_BYTES = 64 << 20
SHARD_BYTES = 8 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "file string, part string, records bigint, bytes bigint, sha256 string"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def file_system(uri: str):
    """(file system, path) of a folder that executors share, as Spark names it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def _record(kind: str, headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", len(block))])
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + gz.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = LEVEL) -> bytes:
    """One compressed record; a revisit keeps the headers of the payload but not the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers: list[tuple[str, object]] = [("WARC-Record-ID", record_id(page_id, digest + ("r" if revisit else "")))]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        headers.append(("WARC-Page-ID", page_id))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    if revisit:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", record_id(refers_to, digest)))
        if refers_to is not None:
            headers.append(("WARC-Refers-To-Page-ID", refers_to))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record("revisit" if revisit else "response", headers, block, level)


class _Rolling:
    """Files of one shard: NAME-00000, NAME-00001 … each closed before it passes the roll size."""

    def __init__(self, folder: str, attempt: str, shard: int, roll_bytes: int, level: int) -> None:
        self.fs, self.root = file_system(folder)
        self.attempt, self.shard, self.roll, self.level = attempt, shard, roll_bytes, level
        self.number, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size + len(record) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.part = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.part}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._put(_record("warcinfo", [
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
            ], b"format: WARC File Format 1.1\r\n", self.level))
        self._put(record)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.part, self.records, self.size, self.sha.hexdigest()))
            self.number, self.out = self.number + 1, None


def _writer(folder: str, roll_bytes: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Consumes rows ordered by shard, id, digest, ``is_page``: notes on copies come before their pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, files, note, noted, answered = uuid.uuid4().hex, None, None, None, False
        done = []
        for batch in batches:
            for shard, page_id, digest, is_page, winner, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (page_id, digest)
                if not is_page:
                    if noted != key:
                        noted, note, answered = key, winner, False
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = _Rolling(folder, attempt, shard, roll_bytes, level)
                revisit = noted == key and (note != page_id or answered)
                answered = answered or noted == key
                files.add(page_record(page_id, url, (html or "").encode(), note if revisit else None, revisit, level))
        if files is not None:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "part", "records", "bytes", "sha256"],
        )

    return run


def _commit(folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Renames listed files; done again after a loss, it finds them renamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = file_system(folder)
        for b in batches:
            for part, name in zip(b["part"], b["file"], strict=True):
                if files.get_file_info(f"{root}/{part}").type == fs.FileType.File:
                    files.move(f"{root}/{part}", f"{root}/{name}")
            yield b

    return run


def write(
    pages: DataFrame, folder: str, least: int = LEAST_REVISIT, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest, which is also stored in ``folder``."""
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("bigint").alias("n"), "url", "html"
    )
    narrow = stored(rows.select("page_id", "digest", "n"), "pages")
    total = narrow.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    cuts = bounds(narrow, "page_id", total["rows"], -(-(total["n"] or 0) // shard_bytes))
    copied = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    # A hot payload's pages meet its one winner here; the adaptive join splits them.
    notes = narrow.select("page_id", "digest").join(copied, "digest").select(
        "page_id", "digest", F.lit(False).alias("is_page"), "winner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")
    )
    records = rows.select("page_id", "digest", F.lit(True).alias("is_page"), F.lit(None).cast("bigint").alias("winner"), "url", "html")
    order = [F.asc("shard"), F.asc_nulls_first("page_id"), F.asc("digest"), F.asc("is_page"), F.asc_nulls_first("url")]
    ranged = with_range(records.unionByName(notes), "page_id", cuts, "shard").repartition(max(partitions(spark), len(cuts) + 1), "shard").sortWithinPartitions(*order)
    files, root = file_system(folder)
    files.create_dir(f"{root}/_temporary", recursive=True)
    ordered = ranged.select("shard", "page_id", "digest", "is_page", "winner", "url", "html")
    manifest = stored(ordered.mapInArrow(_writer(folder, roll_bytes, level), MANIFEST), "manifest")
    committed = manifest.repartition(F.col("file")).mapInPandas(_commit(folder), MANIFEST)
    committed.select("file", "records", "bytes", "sha256").write.mode("overwrite").parquet(f"{folder}/manifest")
    files.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open file, one gzip member at a time."""
    rest = b""
    while True:
        gz, parts = zlib.decompressobj(31), []
        while not gz.eof:
            chunk = rest or stream.read(1 << 20)
            if not chunk:
                if parts:
                    raise ValueError("a record is cut short")
                return
            parts.append(gz.decompress(chunk))
            rest = gz.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = body[:int(headers["Content-Length"])]
        if not lines[0].startswith("WARC/") or body[len(block):] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, block


def _reader(folder: str, with_payload: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in parse(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if hashlib.sha1(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["Content-Length"])):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']}")
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                        rows.append((
                            number("WARC-Page-ID"), headers.get("WARC-Target-URI"), kind, int(fields["Content-Length"]), digest,
                            number("WARC-Refers-To-Page-ID"), payload if with_payload and kind == "response" else None,
                        ))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the files in the manifest, digests checked; one task reads whole files."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file")
    return manifest.repartition(partitions(spark), "file").mapInArrow(_reader(folder, with_payload), RECORDS)
