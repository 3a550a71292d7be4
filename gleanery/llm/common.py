"""What several operators share: tables, the shared folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch to ARROW_BYTES where the session allows more (64 MB by default).

    Plans read this when they run, so it can't be put back before a result that is returned unrun; it is the one
    setting that the operators touch, it is only ever lowered, to the same value, and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864").rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def stretches(batch, column: int, most: int = 4 << 20):
    """An Arrow batch in parts whose values in `column` hold about `most` bytes each, so that a worker's copies of texts stay bounded whatever the session's batch size."""
    n, at = batch.num_rows, 0
    if batch.column(column).nbytes <= most:
        yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def unlike(names) -> str:
    """A column name that none of the names is."""
    return "_text" + "_" * max(map(len, names), default=0)


def scored(docs: DataFrame, scorer, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep (but for a column named score) and score, for every row; scorer() makes a task's function from texts to scores. No shuffle."""
    import pyarrow as pa
    from pyspark.sql import types as T

    bounded_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c != "score")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def rows(batches):
        of = scorer()
        for batch in batches:
            for part in stretches(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(of(part.column(len(keep)).to_pylist()), pa.float64())], [*keep, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(unlike(keep))).mapInArrow(rows, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for rows whose crc32 of the id as text leaves remainder 0 by 5; no label of theirs is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, longest: int, total: int):
    """(texts, targets, share of ones among all usable labels): at most so many rows of each label, in the order of a hash of the id.

    Held-out rows are never taken; neither are texts over `longest` characters (they are scored all
    the same); what exceeds `total` characters is left. The bounds hold at every size of input.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    picked = None
    for y, most in ((1, positives), (0, negatives)):
        some = usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.where("text is not null").where(F.length("text") <= longest).select("doc_id", "text")
    # ids and lengths first, then no more texts than fit; of rows that share an id the smallest text counts
    lengths = texts.select("doc_id", F.length("text").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("y").alias("y"))
    chosen, held = {}, 0
    for row in lengths.orderBy(order, "doc_id").limit(positives + negatives).collect():
        held += row["n"]
        if held > total:
            break
        chosen[row["doc_id"]] = row["y"]
    if not chosen:
        return [], [], 0.0
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    found_texts = {r["doc_id"]: r["text"] for r in texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toLocalIterator()}
    found, ys = [found_texts[i] for i in chosen], list(chosen.values())
    n = sum(counts.values())
    return found, ys, counts.get(1, 0) / n if n else 0.0


def best_cut(logits, targets, weights) -> float:
    """The cut with least weighted error, in the middle of its gap."""
    import numpy as np

    order = np.argsort(logits, kind="stable")
    z, y, w = logits[order], targets[order], weights[order]
    wrong = np.concatenate(([0.0], np.cumsum(w * y))) + np.concatenate((np.cumsum((w * (1 - y))[::-1])[::-1], [0.0]))
    ends = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    same = np.concatenate(([False], z[1:] == z[:-1], [False]))
    wrong[same] = np.inf
    gap = np.concatenate(([1.0], z[1:] - z[:-1], [1.0]))
    near = wrong <= wrong.min() + 1e-12
    return float(ends[np.where(near, gap, -1).argmax()])
