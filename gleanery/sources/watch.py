"""A folder as a streaming source of events: files added, changed and taken away.

    spark.dataSource.register(FolderEvents)
    spark.readStream.format("folder_events").option("path", folder).option("state", place).load()

A listing of the folder is written to the state folder whenever it differs from the one before; an offset is the number of a listing,
and a batch is what lies between two of them, so that a batch that runs again gives the same events and a restart goes on from the
checkpoint's listing.  Of several changes between two listings the last counts, and what came and went in between gives
nothing.  A file counts as it is once it has not been written to for `settle` seconds; until then it is as it was.  Listings are
dealt to tasks by a hash of the path; they hold paths, sizes and times, never contents, and those before the last batch are taken away.
Folders are read through pyarrow: local or mounted ones, HDFS and object stores.
"""

from __future__ import annotations

import fnmatch
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

IGNORED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")
_LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("part", pa.int32())])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Between(InputPartition):
    def __init__(self, before: int, after: int, part: int):
        self.before, self.after, self.part = before, after, part


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"], options["state"]
        self.pattern, self.parts = options.get("pattern", "*"), int(options.get("parts", "8"))
        self.settle = float(options.get("settle", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def _numbers(self) -> list[int]:
        files, place = _opened(self.state)
        files.create_dir(place, recursive=True)
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(place))]
        return sorted(int(n.removeprefix("listing-").removesuffix(".parquet")) for n in names if n.startswith("listing-") and n.endswith(".parquet"))

    def _listing(self, number: int, part: int | None = None) -> pa.Table:
        if not number:
            return _LISTING.empty_table()
        files, place = _opened(self.state)
        filters = None if part is None else pc.field("part") == part
        return pq.read_table(f"{place}/listing-{number}.parquet", filesystem=files, filters=filters)

    def _scan(self, before: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
        """size and time of each file that matches; a file still being written to is as it was before."""
        files, root = _opened(self.root)
        found, edge = {}, (time.time() - self.settle) * 1e6
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            path = info.path[len(root) :].lstrip("/")
            steps = path.split("/")
            if info.type != fs.FileType.File or not fnmatch.fnmatch(steps[-1], self.pattern) or any(s in IGNORED or s.startswith(".") for s in steps):
                continue
            now = (info.size, (info.mtime_ns or 0) // 1000)
            if now[1] <= edge:
                found[path] = now
            elif path in before:
                found[path] = before[path]
        return found

    def latestOffset(self) -> dict:  # noqa: N802
        number = max(self._numbers(), default=0)
        rows = self._listing(number).to_pydict()
        before = dict(zip(rows["path"], zip(rows["size"], rows["mtime"], strict=True), strict=True))
        now = self._scan(before)
        if now == before:
            return {"listing": number}
        names = sorted(now)
        table = pa.table([names, [now[n][0] for n in names], [now[n][1] for n in names], [zlib.crc32(n.encode()) % self.parts for n in names]], schema=_LISTING)
        files, place = _opened(self.state)
        begun = f"{place}/.begun-{number + 1}"
        pq.write_table(table, begun, filesystem=files)
        files.move(begun, f"{place}/listing-{number + 1}.parquet")
        return {"listing": number + 1}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(start["listing"], end["listing"], p) for p in range(self.parts)] if start["listing"] < end["listing"] else []

    def read(self, partition: Between) -> Iterator[tuple]:
        was, now = (self._listing(n, partition.part).to_pydict() for n in (partition.before, partition.after))
        old = dict(zip(was["path"], zip(was["size"], was["mtime"], strict=True), strict=True))
        new = dict(zip(now["path"], zip(now["size"], now["mtime"], strict=True), strict=True))
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                kind = "add" if path not in old else "unlink" if path not in new else "change"
                yield (path, kind, *(new.get(path) or (None, None)), partition.after)

    def commit(self, end: dict) -> None:
        files, place = _opened(self.state)
        for number in self._numbers():
            if number < end["listing"]:
                files.delete_file(f"{place}/listing-{number}.parquet")


class FolderEvents(DataSource):
    """path (within the folder), type (add, change, unlink), size, mtime (microseconds) and seq of each event. Options: path, state (a folder of its own), pattern, settle (seconds), parts."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return "path string, type string, size bigint, mtime bigint, seq bigint"

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options)
