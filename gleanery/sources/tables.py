"""Tables that are written once and read by several plans: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, in folders by some columns if so said; cuts lineage and outlives lost executors."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have too few splits to use them; one shuffle of a small table, none of a large one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_ROW = (1 << 33) - 1


def ranked(df: DataFrame, *order: str, name: str = "ranked") -> DataFrame:
    """df with _at, the place of each row from 0 in the order of some columns, the last of them unique; no task sees all rows.

    The rows are sorted by ranges and written once, each with the number of its task and its place there; how many rows a
    task has comes from that same table. (Counting in another plan of the same ranges would not do: ranges are sampled
    and partitions joined anew for each plan.)
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    task = F.shiftright("_id", 33)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    # one row a task
    numbered = rows.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return numbered.withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND(_ROW)).drop("_task", "_before", "_id")


def _files(spark: SparkSession, root: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    return base, base.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str, prefix: str) -> list[tuple[int, str]]:
    """(number, path) of the whole tables named prefix-number in a folder, by number; one that a failure left half written has no mark and is no table."""
    base, files = _files(spark, root)
    if not files.exists(base):
        return []
    found = [s.getPath() for s in files.listStatus(base) if s.getPath().getName().startswith(f"{prefix}-")]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((int(p.getName().rpartition("-")[2]), p.toString()) for p in whole)


def removed(spark: SparkSession, path: str) -> None:
    """Take a table away, with all its files."""
    base, files = _files(spark, path)
    files.delete(base, True)


def put_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small state as one JSON file, put in place at once."""
    import json

    base, files = _files(spark, path)
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(begun, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    files.delete(base, False)
    if not files.rename(begun, base):
        raise OSError(f"{path} can't be put in place")


def get_state(spark: SparkSession, path: str) -> dict | None:
    """The state put there; None if there is none or what is there is damaged."""
    import json

    from py4j.protocol import Py4JJavaError

    base, files = _files(spark, path)
    if not files.exists(base):
        return None
    stream = files.open(base)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    except Py4JJavaError as failure:
        if "ChecksumException" in str(failure.java_exception):
            return None
        raise
    finally:
        stream.close()
