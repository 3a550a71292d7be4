"""Structured Streaming: incremental ingest, windows and sessions, rate limits and expiring state.

Every stateful function has a batch twin, so that a stream over static rows can be held to the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.streaming import folds, stateful


def parquet_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts, which has to be an instant; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    rows = timed(events, late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    rows = timed(events, late)
    return rows.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    rows = timed(events, late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def coalesced(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One event a file of a micro-batch: unlink if there was one, else add if it began with one, else change."""
    e = events.groupBy(*keys).agg(F.min(F.struct(order, "type")).alias("first"), F.max((F.col("type") == "unlink").cast("int")).alias("gone"), F.max(order).alias("last"))
    return e.select(*keys, F.when(F.col("gone") == 1, "unlink").when(F.col("first.type") == "add", "add").otherwise("change").alias("type"), "last")


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Run apply on each micro-batch; what comes twice after a failure has the same batch number."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(**trigger) if trigger else writer).start()


def usage_once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each idempotency key once."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["idempotency_key"]) if events.isStreaming else events.dropDuplicates(["idempotency_key"])


def in_flight(requests: DataFrame) -> DataFrame:
    """Equal requests (request_id, query) of a batch answered by one: request_id and the leader that runs."""
    keyed = requests.withColumn("k", F.sha2(F.col("query"), 256))
    return keyed.join(keyed.groupBy("k").agg(F.min("request_id").alias("leader")), "k").select("request_id", "leader")


def fixed_windows(events: DataFrame, width: int, most: int) -> DataFrame:
    """Epoch-aligned windows of seconds: key, start, n and how many were over the limit."""
    start = (F.floor(F.unix_timestamp("ts") / width) * width).alias("start")
    return events.groupBy("key", start).agg(F.count("*").alias("n")).withColumn("rejected", F.greatest(F.lit(0), F.col("n") - most))


def _folded(events: DataFrame, columns: list[str], made: str, fold: folds.Fold) -> DataFrame:
    """event_id, key and what a fold says of each event (ts and columns), key by key in the order of time and id.

    A batch: rows come sorted, and a task holds one Arrow batch and the state of one key, however many events a key has.
    A stream: see stateful.InOrder; what it gives in all is what the batch gives, whatever files the events come in.
    """
    if events.isStreaming:
        return stateful.in_order(events, columns, made, fold)
    name, kind = made.split()
    rows = events.select("event_id", "key", "ts", *columns).repartition("key").sortWithinPartitions("key", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for key, t, *more in zip(batch["key"], stateful.micros(batch["ts"]), *(batch[c] for c in columns), strict=True):
                if key != now:
                    now, state = key, fold.start()
                state, value = fold.step(state, t, *more)
                out.append(value)
            yield pd.DataFrame({"event_id": batch["event_id"], "key": batch["key"], name: out})

    return rows.mapInPandas(run, f"event_id bigint, key {events.schema['key'].dataType.simpleString()}, {name} {kind}")


def anchored_limit(events: DataFrame, width: float, most: int) -> DataFrame:
    """Whether each event is allowed: a window opens with a key's first event and lasts `width` seconds."""
    return _folded(events, [], "allowed boolean", folds.anchored(width, most))


def quota(events: DataFrame, width: int, most: int) -> DataFrame:
    """Whether each event is allowed: `most` in each window of `width` seconds, aligned to the epoch."""
    return _folded(events, [], "allowed boolean", folds.aligned(width, most))


def token_bucket(events: DataFrame, burst: int = 100, refill_seconds: float = 1.0) -> DataFrame:
    """Whether each event is allowed: a token comes back each whole refill interval."""
    return _folded(events, [], "allowed boolean", folds.bucket(burst, refill_seconds))


def breaker(events: DataFrame, failures: int = 5, rest: float = 30.0) -> DataFrame:
    """event_id and state before each event (ok tells its outcome): closed, open after so many failures in a row, half-open after the rest."""
    return _folded(events, ["ok"], "state string", folds.breaker(failures, rest))


def recently_used(events: DataFrame, most: int) -> DataFrame:
    """What each use of an item (item) does to a cache of `most` items a key: hit, or the items that go, least recently used first."""
    return _folded(events, ["item"], "evicted array<string>", folds.recently_used(most))


def session_registry(events: DataFrame, most: int, idle: float) -> DataFrame:
    """What each use of a session (item) makes a registry (key) of `most` sessions let go: idle ones, and the first opened where there is no room."""
    return _folded(events, ["item"], "gone array<string>", folds.registry(most, idle))


def sliding_ttl(stream: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """key, first, last and n of each life of a key (event_id, key, ts): it ends `seconds` after its last event; the next event begins another.

    A batch gives all lives; a stream gives a life when the watermark has passed its end.
    """
    if stream.isStreaming:
        return stateful.lives(stream, seconds)
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce(micros - F.lag(micros).over(order) >= seconds * 1_000_000, F.lit(True))
    life = F.sum(F.col("fresh").cast("int")).over(order)
    rows = stream.withColumn("fresh", fresh).withColumn("life", life)
    return rows.groupBy("key", "life").agg(F.min("ts").cast("timestamp").alias("first"), F.max("ts").cast("timestamp").alias("last"), F.count("*").alias("n")).drop("life")


def last_per_key(events: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
