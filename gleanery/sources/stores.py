"""A vector store's database file as a batch source, and what of it is new to a corpus.

    spark.dataSource.register(VectorStore)
    spark.read.format("vector_store_file").option("path", file).load()

The file (SQLite, with tables collections, embeddings, embedding_metadata and, in newer ones, embedding_fulltext) is read by ranges of row
numbers, one connection a task, so it has to lie where all executors can open it. A file without the first two tables is refused.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_part = options["path"].removeprefix("file://"), int(options.get("rows", "10000"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        base = self._open()
        try:
            base.execute("SELECT 1 FROM collections LIMIT 1")
            low, high = base.execute("SELECT min(rowid), max(rowid) FROM embeddings").fetchone()
        except sqlite3.Error as failure:
            raise ValueError(f"{self.path} is no vector store: {failure}") from failure
        finally:
            base.close()
        return [] if low is None else [Rows(at, at + self.per_part) for at in range(low, high + 1, self.per_part)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        base = self._open()
        names = {r[0] for r in base.execute("SELECT name FROM sqlite_master")}
        text = "(SELECT f.string_value FROM embedding_fulltext f WHERE f.rowid = e.rowid)" if "embedding_fulltext" in names else "NULL"
        meta = "SELECT key, coalesce(string_value, int_value) FROM embedding_metadata WHERE id = ? ORDER BY rowid"
        rows = base.execute(f"SELECT e.id, e.embedding_id, c.name, {text} FROM embeddings e JOIN collections c ON e.collection_id = c.id WHERE e.rowid >= ? AND e.rowid < ? ORDER BY e.rowid", (partition.first, partition.end))
        try:
            for uuid, name, collection, said in rows.fetchall():
                found = dict(base.execute(meta, (uuid,)).fetchall())
                path, title = name, None
                for key, value in found.items():
                    if key in ("source", "path", "file") and isinstance(value, str):
                        path = value
                    if key == "title" and isinstance(value, str):
                        title = value
                yield (str(uuid), collection, path, title, said if said is not None else found.get("chroma:document"), json.dumps(found, sort_keys=True))
        finally:
            base.close()


class VectorStore(DataSource):
    """id, collection, path (source, path or file of its metadata, else its name), title, text and metadata (JSON) of each entry. Options: path, rows (row numbers a task)."""

    @classmethod
    def name(cls) -> str:
        return "vector_store_file"

    def schema(self) -> str:
        return "id string, collection string, path string, title string, text string, metadata string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def fresh(entries: DataFrame, corpus: DataFrame, collection: str) -> DataFrame:
    """Documents (collection, path, hash, title, text) that entries of a store add to a corpus (collection, path, hash): those with a text that the path does not hold yet.

    Of entries that share a path the one of smallest id counts; so importing a store twice adds nothing the second time.
    """
    rows = entries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    one = rows.groupBy("path").agg(F.min_by(F.struct("title", "text"), "id").alias("e")).select(F.lit(collection).alias("collection"), "path", F.sha2(F.col("e.text"), 256).alias("hash"), F.col("e.title").alias("title"), F.col("e.text").alias("text"))
    return one.join(corpus.select("collection", "path", "hash"), ["collection", "path", "hash"], "left_anti")
