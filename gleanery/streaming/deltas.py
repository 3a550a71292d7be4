"""A keyed table kept as a base and deltas: a batch of changes writes what it changes, reads merge, compaction folds deltas in.

In a folder: base-n is the table after batch n, delta-n what batch n changed: the last event of each key, and whether it took the
key out. A table without its mark of success is none, so what a failure left half written is never read, and the batch that runs again
writes the same delta in its place. A reader lists the folder once, so compaction leaves what it lists until `vacuum`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources.tables import committed, removed


class Deltas:
    """The table of a folder; schema and key are those of its rows."""

    def __init__(self, spark: SparkSession, root: str, schema, key: str = "path"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [c for c in self.schema.names if c != key]
        self.written = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])

    def start(self, rows: DataFrame) -> None:
        """The table before any batch; a folder that has one already keeps it."""
        if not committed(self.spark, self.root, "base"):
            rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/base--1")

    def _base(self) -> tuple[int, str] | None:
        # the base before batch 0 is named base--1, which reads as 1: it is told by its name
        found = [(-1 if path.endswith("--1") else n, path) for n, path in committed(self.spark, self.root, "base")]
        return max(found, default=None)

    def apply(self, events: DataFrame, number: int) -> None:
        """Write the delta of a batch of events (key, type, seq, further columns); bytes grow with the batch, not with the table."""
        last = events.groupBy(self.key).agg(F.max_by(F.struct("type", *self.values), "seq").alias("e"))
        rows = last.select(self.key, *[F.col(f"e.{c}").alias(c) for c in self.values], (F.col("e.type") == "unlink").alias("_gone"))
        rows.write.mode("overwrite").parquet(f"{self.root}/delta-{number}")

    def pending(self) -> list[tuple[int, str]]:
        """Deltas after the base."""
        base = self._base()
        return [(n, p) for n, p in committed(self.spark, self.root, "delta") if base is None or n > base[0]]

    def read(self) -> DataFrame:
        """The table as it is: the base where no delta has its key, and the newest delta of each key; keys of deltas alone are shuffled with it."""
        base, deltas = self._base(), self.pending()
        rows = self.spark.read.schema(self.schema).parquet(base[1]) if base else self.spark.createDataFrame([], self.schema)
        if not deltas:
            return rows
        parts = None
        for number, path in deltas:
            part = self.spark.read.schema(self.written).parquet(path).withColumn("_n", F.lit(number))
            parts = part if parts is None else parts.unionByName(part)
        if len(deltas) > 1:
            newest = Window.partitionBy(self.key).orderBy(F.desc("_n"))
            parts = parts.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
        kept = rows.join(parts.select(self.key), self.key, "left_anti").select(*self.schema.names)
        return kept.unionByName(parts.where("not _gone").select(*self.schema.names))

    def compact(self) -> int | None:
        """Write a base of all deltas there are; the number it stands for, None if there was nothing to fold in."""
        deltas = self.pending()
        if not deltas:
            return None
        number = deltas[-1][0]
        self.read().write.mode("overwrite").parquet(f"{self.root}/base-{number}")
        return number

    def vacuum(self) -> int:
        """Take away bases and deltas that the newest base has made needless; how many."""
        base = self._base()
        old = [] if base is None else [p for n, p in committed(self.spark, self.root, "delta") if n <= base[0]] + [p for _, p in committed(self.spark, self.root, "base") if p != base[1]]
        for path in old:
            removed(self.spark, path)
        return len(old)

    def follow(self, events: DataFrame, trigger: dict | None = None, every: int = 20) -> StreamingQuery:
        """Apply a stream of events batch by batch, and fold deltas in when there are `every` of them."""

        def step(batch: DataFrame, number: int) -> None:
            self.apply(batch, number)
            if len(self.pending()) >= every:
                self.compact()
                self.vacuum()

        writer = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/state")
        return (writer.trigger(**trigger) if trigger else writer).start()
