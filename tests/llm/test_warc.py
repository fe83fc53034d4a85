from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from pathlib import Path

import pytest

from starledger.llm import warc

HTML = "<html><p>café \r\n\r\n WARC/1.1 inside</p></html>"
PAGES = [
    (1, "http://a.example/1", HTML),
    (2, "http://a.example/2", "other"),
    (3, "http://a.example/3 with space\n", HTML),
    (7, None, HTML),
    (4, "u", None),
    (5, "u", ""),
    (-6, "u", "x" * 3_000_000),
    (2**40 + 5, "u", "other"),
    (None, "u", "no id"),
    (8, "u", "twice"),
    (8, "u", "twice"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS digest", "'y' AS keeper", "'z' AS payload"
    )


def expected(least=0):
    rows = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        keeper = max(same, default=None)
        revisit = len(payload) >= least and keeper is not None and keeper != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind, refers = ("revisit", keeper) if revisit else ("response", None)
        rows.append((page, len(payload), digest, kind, refers))
    return sorted(rows, key=str)


def told(records):
    return sorted(
        (
            (
                warc.page_of(r["record_id"]),
                r["payload_bytes"],
                r["payload_digest"],
                r["record_type"],
                warc.page_of(r["refers_to"]),
            )
            for r in records.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("least", [0, 1, 10])
def test_round_trip(pages, least):
    _, records = warc.archive_pages(pages, min_revisit_bytes=least)
    assert told(records) == expected(least)


def test_broadcast_and_shuffle_agree(pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert told(warc.archive_pages(pages)[1]) == expected()


def test_members_and_index(pages, tmp_path, monkeypatch):
    """Whole-file streams go in; one member a record comes out, where the sidecar says."""
    rows = warc.page_records(pages.coalesce(1))
    manifest = warc.write_archives(rows, f"{tmp_path}/crawl", archive_bytes=1000)
    assert manifest.count() > 1
    for path in manifest.collect():
        with gzip.open(path["archive"]) as whole:
            assert whole.read().count(b"WARC-Record-ID") == path["records"]
    index = warc.normalise(manifest, f"{tmp_path}/normal", span_bytes=500).collect()
    assert len(index) == len(PAGES)
    for entry in index:
        with open(entry["archive"], "rb") as file:
            file.seek(entry["offset"])
            record = gzip.decompress(file.read(entry["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert entry["record_id"].encode() in record
    sidecars = list(Path(f"{tmp_path}/normal").glob("*.cdxj"))
    lines = [json.loads(x[x.index("{") :]) for p in sidecars for x in p.read_text().splitlines()]
    assert {(x["id"], x["offset"], x["length"]) for x in lines} == {
        (e["record_id"], e["offset"], e["length"]) for e in index
    }


def test_a_cut_archive_is_refused(pages, tmp_path, spark):
    rows = warc.page_records(pages.coalesce(1))
    path = warc.write_archives(rows, f"{tmp_path}/crawl").first()["archive"]
    whole = gzip.open(path).read()
    Path(path).write_bytes(gzip.compress(whole[: len(whole) // 2]))
    manifest = spark.createDataFrame([(path, 1, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="ends inside a record"):
        warc.normalise(manifest, f"{tmp_path}/normal").collect()


def test_streams_that_are_cut_between_records_are_refused(pages, tmp_path, spark):
    """The stream ends behind a record, without its last blocks or without its trailer."""
    rows = warc.page_records(pages.coalesce(1))
    made = warc.write_archives(rows, f"{tmp_path}/crawl").first()
    whole = gzip.open(made["archive"]).read()
    border = whole.index(b"\r\n\r\nWARC/1.1") + 4
    deflate = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    flushed = deflate.compress(whole[:border]) + deflate.flush(zlib.Z_SYNC_FLUSH)
    cut = {
        "border": (flushed, "ends inside its gzip stream"),
        "trailer": (gzip.compress(whole)[:-8], "ends inside its gzip stream"),
        "fewer": (gzip.compress(whole[:border]), "has 1 records, not"),
    }
    for name, (data, message) in cut.items():
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        manifest = spark.createDataFrame([(str(path), made["records"], 1)], warc.MANIFEST)
        with pytest.raises(Exception, match=message):
            warc.normalise(manifest, f"{tmp_path}/normal").collect()
    empty = tmp_path / "empty.warc.gz"
    empty.write_bytes(b"")
    manifest = spark.createDataFrame([(str(empty), 0, 0)], warc.MANIFEST)
    assert warc.normalise(manifest, f"{tmp_path}/normal").collect() == []


def test_paths_are_those_of_the_default_file_system(spark, tmp_path):
    """A path without a scheme belongs to Spark's default file system, not to each executor's disk."""
    assert warc.resolved(spark, str(tmp_path)) == str(tmp_path)
    assert warc.resolved(spark, f"file://{tmp_path}") == str(tmp_path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./archives", f"file://{tmp_path}")
    try:
        assert warc.resolved(spark, "/archives").startswith("viewfs://shared/")
    finally:
        conf.set("fs.defaultFS", before)


@pytest.mark.parametrize("page", [0, 1, -1, 2**63 - 1, -(2**63), 2**40 + 5])
def test_ids_hold_pages(page):
    assert warc.page_of(warc.record_id(page)) == page


def test_empty_table(pages):
    assert warc.archive_pages(pages.limit(0))[1].collect() == []
