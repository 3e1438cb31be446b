"""Archives read back, revisits, rolling, and the same files from the same pages."""

import gzip
import hashlib

import pytest

from riskfeat.llm import warc

LONG = "long page é " * 200
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2\r\nX: y", LONG), (3, None, LONG), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "http://a/7", ""),
    (8, "http://a/8", LONG + "8"), (8, "http://a/8", LONG + "8"), (8, "http://b/8", "other"), (None, "http://a/none", LONG + "n"), (9, "http://a/9", "x" * 999), (10, "http://a/10", "x" * 999),
    (11, "http://a/11", "y" * 1000), (12, "http://a/12", "y" * 1000),
] + [(k, f"http://h/{k}", f"page {k} " * k) for k in range(20, 120)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    df = spark.createDataFrame([(*r, 0, "s") for r in ROWS], "page_id bigint, url string, html string, shard int, digest string").repartition(5)
    return folder, warc.write(df, folder, roll_bytes=6_000, shard_bytes=20_000)


def test_read_back(spark, written):
    folder, _ = written
    got = warc.read(spark, folder, with_payload=True).collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (i or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in ROWS)
    kind = {(r["page_id"], r["payload_digest"]): [] for r in got}
    for r in got:
        kind[(r["page_id"], r["payload_digest"])].append((r["record_type"], r["refers_to"]))
    of = lambda i, h: sorted(kind[(i, hashlib.sha1(h.encode()).hexdigest())], key=str)
    assert of(1, LONG) == of(2, LONG) == [("revisit", 3)] and of(3, LONG) == [("response", None)]
    assert of(8, LONG + "8") == [("response", None), ("revisit", 8)]
    assert of(4, "short") == of(5, "short") == of(9, "x" * 999) == of(10, "x" * 999) == [("response", None)]
    assert of(11, "y" * 1000) == [("revisit", 12)] and of(12, "y" * 1000) == [("response", None)]
    html = {(i, h or "") for i, _, h in ROWS}
    assert all((r["page_id"], bytes(r["payload"]).decode()) in html for r in got if r["record_type"] == "response")
    assert {r["url"] for r in got if r["page_id"] == 2} == {"http://a/2%0D%0AX: y"} and {r["url"] for r in got if r["page_id"] == 3} == {None}


def test_files_are_sorted_rolled_and_listed(spark, written, tmp_path):
    folder, manifest = written
    rows = {r["file"]: r for r in manifest.collect()}
    from pathlib import Path

    files = sorted(p.name for p in Path(folder).glob("*.warc.gz"))
    assert files == sorted(rows) and not list(Path(folder).glob("_temporary/*"))
    assert len({f.split("-")[1] for f in files}) > 1 and any(f.endswith("-00001.warc.gz") for f in files)
    ids = []
    for f in files:
        data = Path(folder, f).read_bytes()
        assert len(data) == rows[f]["bytes"] and hashlib.sha256(data).hexdigest() == rows[f]["sha256"]
        assert len(data) <= 6_000 or rows[f]["records"] == 1
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == rows[f]["records"] + 1
        ids += [h.get("WARC-Page-ID") for h, _ in warc.parse(Path(folder, f).open("rb")) if h["WARC-Type"] != "warcinfo"]
    numbers = [int(i) if i else -1 for i in ids]
    assert numbers == sorted(numbers)


def test_same_files_from_other_partitions(spark, written, tmp_path):
    _, manifest = written
    df = spark.createDataFrame(ROWS[::-1], "page_id bigint, url string, html string").repartition(2)
    again = warc.write(df, str(tmp_path), roll_bytes=6_000, shard_bytes=20_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path))
    assert warc.read(spark, str(tmp_path)).count() == 0
