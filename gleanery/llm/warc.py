"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package holds one stored member of gzipped WARC records, one stored CDXJ index (a line per record,
sorted) and a small description.  A response record holds an HTTP message, a revisit its head alone.  The
reader fetches the tail, parses the end record, the ZIP64 records and the central directory, finds the
stored members through their local headers, reads the index, and then fetches single records by byte
range.  Members that are compressed are listed, and an archive or index among them is refused by name.

Files are opened through pyarrow's file systems from URIs, so the shared folder may be local to a
mount, HDFS or an object store.  A task writes a package under a name of its own attempt; only names
that successful attempts report are read, so lost executors leave no doubtful files.

Among records with equal payloads (of at least dedup_from bytes) the smallest page_id is the response;
the others are revisits without payload.  Which payloads come up more than once is told from digests
alone; payloads are shuffled only where these are more than BROADCAST_ROWS.  Rows that repeat the
response's page_id are responses too.  Null ids come after all others and are responses if there is
nothing else to refer to.  Null html is an empty payload, a null url an empty one. Empty tables write
nothing and give an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import bounded_batches, shared_dir, table, written

# Fixed values of the formats.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
DIGESTED = "sha1:"
ROLL_BYTES, CHUNK_BYTES, BROADCAST_ROWS = 128 << 20, 4 << 20, 500_000


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def surt(url: str) -> str:
    """The sort key of an index line: host labels from the last to the first, then the path, in lower case."""
    rest = url.partition("://")[2] or url
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].partition(":")[0], rest[cut:].partition("#")[0]
    return f"{','.join(reversed(host.split('.')))}){path or '/'}".lower()


def _pack(head: list[str], block: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def warc_record(record_id: str, page_id: int | None, url: str, date: str, payload: bytes, refers_to: tuple[int, str] | None, digest: str) -> bytes:
    """One gzip member with one record; a revisit, which refers to (page_id, url), carries the head of the HTTP message alone."""
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = message if refers_to else message + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {DIGESTED}{digest}",
        f"WARC-Block-Digest: {DIGESTED}{bare_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {refers_to[1]}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
    return _pack(lines, block)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.partition(":")[::2] for line in head.decode().split("\r\n")[1:])


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(fields of the record, fields of the HTTP message, payload); the block must have the digest that is said of it."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k: v.strip() for k, v in _fields(head).items()}
    block = rest[: int(fields["Content-Length"])]
    if bare_digest(block) != fields["WARC-Block-Digest"].removeprefix(DIGESTED):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
    message, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k: v.strip() for k, v in _fields(message).items()}, payload


class StoredZip:
    """Writes stored members to a stream that can't seek; ZIP64 fields throughout where zip64 is set or sizes ask for it."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self._now = [name.encode(), self.at, 0, 0]
        # bit 3: sizes and checksum follow the data; bit 11: the name is UTF-8
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        sizes = 0xFFFFFFFF if self.zip64 else 0
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if self.zip64 else 20, 0x808, 0, 0, 33, 0, sizes, sizes, len(self._now[0]), len(extra)) + self._now[0] + extra)

    def add(self, data: bytes) -> None:
        self._now[2] = zlib.crc32(data, self._now[2])
        self._now[3] += len(data)
        self._put(data)

    def finish(self) -> None:
        _, _, crc, size = self._now
        self._put(struct.pack("<4sIQQ" if self.zip64 else "<4sIII", b"PK\x07\x08", crc, size, size))
        self.members.append(tuple(self._now))

    def close(self) -> None:
        begin = self.at
        for name, at, crc, size in self.members:
            big = self.zip64 or max(at, size) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            small = [0xFFFFFFFF] * 3 if big else [size, size, at]
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 33, crc, small[0], small[1], len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", EOCD64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, end, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4sHHHHIIH", EOCD, 0, 0, n, n, size, begin, 0))


def _end_record(tail: bytes) -> int:
    """Where the end record is: its comment reaches to the end of the file, whatever the comment holds."""
    at = len(tail)
    while (at := tail.rfind(EOCD, 0, at + 3 if at < len(tail) else at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] == len(tail):
            return at
    raise ValueError("not a ZIP package: no end record")


def listing(source, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, bytes) of every member, by the central directory; source(offset, length) reads a range."""
    tail_at = max(0, size - 65557)
    tail = source(tail_at, size - tail_at)
    at = _end_record(tail)
    n, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    if (n == 0xFFFF or 0xFFFFFFFF in (length, begin)) and at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        record = source(end64, 56)
        if record[:4] != EOCD64:
            raise ValueError("damaged ZIP64 end record")
        n, length, begin = struct.unpack("<QQQ", record[32:56])
    directory, at, found = source(begin, length), 0, []
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, full = struct.unpack("<H", directory[at + 10 : at + 12])[0], *struct.unpack("<II", directory[at + 20 : at + 28])
        name_n, extra_n, note_n = struct.unpack("<HHH", directory[at + 28 : at + 34])
        (where,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:  # the ZIP64 field has just the values that don't fit, in this order
            tag, n_bytes = struct.unpack("<HH", extra[:4])
            if tag == 1:
                big = list(struct.unpack(f"<{n_bytes // 8}Q", extra[4 : 4 + n_bytes // 8 * 8]))
                full = big.pop(0) if full == 0xFFFFFFFF else full
                packed = big.pop(0) if packed == 0xFFFFFFFF else packed
                where = big.pop(0) if where == 0xFFFFFFFF else where
            extra = extra[4 + n_bytes :]
        found.append((name, method, where, packed))
        at += 46 + name_n + extra_n + note_n
    return found


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """name: (offset of the data, size), of the stored members; listing() names the others too."""
    found = {}
    for name, method, where, packed in listing(source, size):
        if method == 0:
            head = source(where, 30)
            if head[:4] != LOCAL:
                raise ValueError("damaged local header")
            found[name] = (where + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
    return found


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _ranges(uri: str):
    files, path = _open(uri)
    stream = files.open_input_file(path)

    def source(offset: int, length: int) -> bytes:
        return stream.read_at(length, offset)

    return source, stream


def with_references(pages: DataFrame, dedup_from: int = 0) -> DataFrame:
    """pages with payload (binary), refers_to and refers_to_url."""
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    slim = full.where(F.octet_length("payload") >= dedup_from).select("sha1", "page_id", "url")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    several = written(pages.sparkSession, slim.groupBy("sha1").agg(first, F.count("*").alias("n")).where("n > 1").select("sha1", "first.page_id", "first.url"), "payloads").toDF("sha1", "first_id", "first_url")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return full.join(several, "sha1", "left").select("page_id", "url", "payload", F.when(other, F.col("first_id")).cast("bigint").alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_to_url"))


def write_packages(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str | None = None) -> DataFrame:
    """Write rows of with_references() to ZIP packages, dated now or as said; one row per package: uri, n_records. Run it once (see written())."""
    bounded_batches(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    stamp = "".join(c for c in date if c.isdigit())[:14]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        task, k, done, out = TaskContext.get(), 0, [], None

        def close():
            nonlocal out
            package.finish()
            package.begin(INDEX)
            package.add("".join(sorted(index)).encode())
            package.finish()
            package.begin(ABOUT)
            package.add(json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}).encode())
            package.finish()
            package.close()
            out.close()
            out = None
            done.append((name, len(index)))

        for batch in batches:
            for page_id, url, payload, refers_to, other in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "refers_to_url")), strict=True):
                if out is None:
                    name = f"{folder.rstrip('/')}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.wacz"
                    out, index, k = files.open_output_stream(_open(name)[1]), [], k + 1
                    package = StoredZip(out)
                    package.begin(ARCHIVE)
                    begin = package.at
                offset, url, digest = package.at - begin, " ".join(url.split()), bare_digest(payload)
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")
                record = warc_record(str(record_id), page_id, url, date, payload, None if refers_to is None else (refers_to, " ".join(other.split())), digest)
                said = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"{DIGESTED}{digest}", "length": str(len(record)), "offset": str(offset), "filename": ARCHIVE.rpartition("/")[2]}
                index.append(f"{surt(url)} {stamp} {json.dumps(said)}\n")
                package.add(record)
                if package.at >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["uri", "n_records"])

    return pages.mapInArrow(pack, "uri string, n_records bigint")


def read_ranges(packages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each package (uri), its records in chunks that lie together: uri, offset, lengths."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                source, stream = _ranges(uri)
                with stream:
                    found = members(source, stream.size())
                    if missing := {ARCHIVE, INDEX} - set(found):
                        raise ValueError(f"{uri}: no stored member {', '.join(sorted(missing))}; it has {[n for n, *_ in listing(source, stream.size())]}")
                    data, _ = found[ARCHIVE]
                    said = [json.loads(line[line.index("{") :]) for line in source(*found[INDEX]).decode().split("\n")[:-1]]
                chunks: list[tuple[int, list[int]]] = []
                held = chunk_bytes
                for offset, length in sorted((int(x["offset"]), int(x["length"])) for x in said):
                    if held >= chunk_bytes:
                        chunks.append((data + offset, []))
                        held = 0
                    chunks[-1][1].append(length)
                    held += length
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(chunks)), pa.array([c[0] for c in chunks], pa.int64()), pa.array([c[1] for c in chunks], pa.list_(pa.int64()))], ["uri", "offset", "lengths"])

    return packages.select("uri").mapInArrow(locate, "uri string, offset bigint, lengths array<bigint>")


def read_records(chunks: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, with_payload, the payload (of responses)."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, stream = _ranges(uri)
                with stream:
                    block = source(offset, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    fields, message, body = parse_record(block[at : at + n])
                    at += n
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix(DIGESTED)
                    if kind == "response" and bare_digest(body) != digest:
                        raise ValueError(f"{uri}: a payload does not have the digest of its record")
                    page_id, refers_to = (int(x) if x else None for x in (fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")))
                    rows.append((page_id, int(message["Content-Length"]), digest, kind, refers_to, body))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                wanted = 6 if with_payload else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:wanted], kinds[:wanted], strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][:wanted])

    return chunks.mapInArrow(fetch, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the packages written of them."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    packages = written(spark, write_packages(with_references(table(spark, sf_dir, "pages")), folder), "packages")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_records(read_ranges(packages).repartition(spread))
