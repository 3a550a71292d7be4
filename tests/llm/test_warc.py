import io
import json
import struct
import zipfile
import zlib

import pytest

from gleanery.llm import common, warc

SCHEMA = "page_id bigint, url string, html string"


def source_of(data):
    return lambda at, n: data[at : at + n]


def written(spark, tmp_path, rows, **more):
    pages = spark.createDataFrame(rows, SCHEMA)
    return common.written(spark, warc.write_packages(warc.with_references(pages), f"file://{tmp_path}/w", **more), "p")


def test_records_are_whole_warc_records(spark, tmp_path):
    packages = written(spark, tmp_path, [(1, "http://www.B.org/x?q#f", "same"), (2, "http://a.org", "same"), (2, "http://a.org", "same"), (3, None, None)], date="2024-05-06T07:08:09Z")
    seen, ids = [], set()
    for row in packages.collect():
        with zipfile.ZipFile(row["uri"].removeprefix("file://")) as z:
            assert z.testzip() is None
            data, lines = z.read(warc.ARCHIVE), z.read(warc.INDEX).decode().splitlines()
        assert lines == sorted(lines) and len(lines) == row["n_records"]
        for line in lines:
            key, stamp, said = line.split(" ", 2)
            said = json.loads(said)
            assert stamp == "20240506070809" and key == warc.surt(said["url"])
            fields, message, payload = warc.parse_record(data[int(said["offset"]) : int(said["offset"]) + int(said["length"])])
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and message["Content-Type"].startswith("text/html") and fields["WARC-Payload-Digest"] == said["digest"]
            ids.add(fields["WARC-Record-ID"])
            seen.append((fields["X-Page-Id"], fields["WARC-Type"], fields.get("WARC-Refers-To-Target-URI"), payload, int(message["Content-Length"])))
    first = "http://www.B.org/x?q#f"
    assert sorted(seen, key=str) == sorted([("1", "response", None, b"same", 4), ("2", "revisit", first, b"", 4), ("2", "revisit", first, b"", 4), ("3", "response", None, b"", 0)], key=str)
    assert len(ids) == 4 and warc.surt(first) == "org,b,www)/x?q"


def test_foreign_packages_with_comments_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(warc.ARCHIVE, b"abc" * 100, zipfile.ZIP_STORED)
        z.writestr("pages/p.jsonl", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with " + warc.EOCD + b"\0" * 18 + b" in it"
    data = out.getvalue()
    found = warc.members(source_of(data), len(data))
    at, n = found[warc.ARCHIVE]
    assert data[at : at + n] == b"abc" * 100 and list(found) == [warc.ARCHIVE]
    assert [(name, method) for name, method, _, _ in warc.listing(source_of(data), len(data))] == [(warc.ARCHIVE, 0), ("pages/p.jsonl", 8)]
    for damaged in (b"", b"PK", data[:-1], data[:40]):
        with pytest.raises(ValueError, match="no end record"):
            warc.members(source_of(damaged), len(damaged))


def test_an_archive_that_is_compressed_is_refused_by_name(spark, tmp_path):
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, b"abc" * 100)
        z.writestr(warc.INDEX, b"")
    with pytest.raises(Exception, match="no stored member archive/data.warc.gz, indexes/index.cdx"):
        warc.read_ranges(spark.createDataFrame([(f"file://{path}",)], "uri string")).collect()


def test_a_damaged_record_is_told():
    record = warc.warc_record("i", 1, "http://x", "d", b"payload", None, warc.bare_digest(b"payload"))
    text = zlib.decompress(record, 31).replace(b"payload\r\n", b"pXyload\r\n")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="does not have its digest"):
        warc.parse_record(pack.compress(text) + pack.flush())
    assert struct.unpack("<H", record[:2])[0] == 0x8B1F


@pytest.mark.parametrize("most", [0, 500_000])
def test_references_however_they_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(5, "u5", "a"), (4, "u4", "a"), (4, "u4", "a"), (None, "n", "a"), (None, "n", "z"), (None, "m", "z"), (7, "u7", None), (8, None, "")]
    got = sorted(((r["page_id"], r["refers_to"], r["refers_to_url"]) for r in warc.with_references(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 4, "u4"), (4, None, None), (4, None, None), (None, 4, "u4"), (None, None, None), (None, None, None), (7, None, None), (8, 7, "u7")], key=str)
    small = warc.with_references(spark.createDataFrame(rows, SCHEMA), dedup_from=1).where("page_id = 8").first()
    assert small["refers_to"] is None


def test_the_query_on_all_pages_and_on_none(spark, tmp_path):
    import base64
    import hashlib

    sf = "/root/testdata/sf0.01"
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    want = sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages)
    assert sorted(tuple(r) for r in warc.op3_warc(spark, sf).collect()) == want
    assert warc.read_records(warc.read_ranges(written(spark, tmp_path, []))).count() == 0
