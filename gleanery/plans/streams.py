"""Queries of streaming operators in their batch form, over events; and queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.plans.catalog import DOCS, docs, query, table
from gleanery.sources.tables import folder
from gleanery.sources.watch import FolderEvents
from gleanery.streaming import events as ops
from gleanery.streaming.deltas import Deltas


def _events(spark, sf):
    return table(spark, sf, "events")


@query("st_coalesce", "SELECT user_id AS collection, event_id % 7 AS path, CASE WHEN bool_or(event_type = 'error') THEN 'unlink' WHEN arg_min(event_type, event_id) = 'signup' THEN 'add' ELSE 'change' END AS type, max(event_id) AS last FROM events GROUP BY ALL")
def st_coalesce(spark, sf):
    kind = F.when(F.col("event_type") == "error", "unlink").when(F.col("event_type") == "signup", "add").otherwise("change")
    e = _events(spark, sf).select(F.col("user_id").alias("collection"), (F.col("event_id") % 7).alias("path"), kind.alias("type"), "event_id")
    return ops.coalesced(e, ["collection", "path"], "event_id")


@query("st_rate_fixed", "SELECT user_id AS key, floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, count(*) AS n, greatest(0, count(*) - 2) AS rejected FROM events GROUP BY ALL")
def st_rate_fixed(spark, sf):
    return ops.fixed_windows(_events(spark, sf).withColumnRenamed("user_id", "key"), 3600, 2)


@query("st_quota", "SELECT user_id || ':' || event_type AS key, floor(epoch(ts) / 86400)::BIGINT * 86400 AS start, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM events GROUP BY ALL")
def st_quota(spark, sf):
    return ops.fixed_windows(_events(spark, sf).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")), 86400, 3)


# the fold of each key's events, one step an event
E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
ANCHORED = f"WITH RECURSIVE {E}, f AS (SELECT user_id, event_id, i, us AS opened, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - opened >= 3600000000 THEN e.us ELSE opened END, CASE WHEN e.us - opened >= 3600000000 THEN 1 ELSE n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, user_id AS key, n <= 2 AS allowed FROM f"
BUCKET = f"""WITH RECURSIVE {E}, f AS (SELECT user_id, event_id, i, us AS last, 3::BIGINT AS had, 2::BIGINT AS tokens FROM e WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, last + back * 7200000000, least(3, tokens + back), greatest(least(3, tokens + back) - 1, 0) FROM (SELECT e.user_id, e.event_id, e.i, last, tokens, (e.us - last) // 7200000000 AS back FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)) SELECT event_id, user_id AS key, had > 0 AS allowed FROM f"""
BREAKER = f"""WITH RECURSIVE {E}, s AS (SELECT user_id, i, event_id, event_type <> 'error' AS ok, us, 'closed' AS before FROM e WHERE i = 1), f AS (SELECT user_id, event_id, i, before, 'closed' AS state, (NOT ok)::INT AS row, 0::BIGINT AS since FROM s
 UNION ALL SELECT user_id, event_id, i, before, CASE WHEN before = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN before = 'half-open' OR row >= 1 THEN 'open' ELSE 'closed' END, CASE WHEN before = 'open' THEN row WHEN ok THEN 0 WHEN before = 'half-open' OR row >= 1 THEN 0 ELSE row + 1 END,
  CASE WHEN before <> 'open' AND NOT ok AND (before = 'half-open' OR row >= 1) THEN us ELSE since END FROM (SELECT e.user_id, e.event_id, e.i, e.us, e.event_type <> 'error' AS ok, f.row, f.since, CASE WHEN f.state = 'open' AND e.us - f.since >= 3600000000 THEN 'half-open' ELSE f.state END AS before FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)) SELECT event_id, before AS state FROM f"""


def _keyed(rows):
    return rows.withColumnRenamed("user_id", "key")


@query("st_rate_anchored", ANCHORED)
def st_rate_anchored(spark, sf):
    return ops.anchored_limit(_keyed(_events(spark, sf)), 3600.0, 2)


@query("st_rate_anchored_stream", ANCHORED)
def st_rate_anchored_stream(spark, sf):
    return _drained(ops.anchored_limit(_keyed(_closed(spark, sf)), 3600.0, 2), "append").where("key >= 0")


@query("st_token_bucket", BUCKET)
def st_token_bucket(spark, sf):
    return ops.token_bucket(_keyed(_events(spark, sf)), 3, 7200.0)


@query("st_token_bucket_stream", BUCKET)
def st_token_bucket_stream(spark, sf):
    return _drained(ops.token_bucket(_keyed(_closed(spark, sf)), 3, 7200.0), "append").where("key >= 0")


def _outcomes(rows):
    return rows.select("event_id", F.col("user_id").alias("key"), "ts", (F.col("event_type") != "error").alias("ok"))


@query("st_breaker", BREAKER)
def st_breaker(spark, sf):
    return ops.breaker(_outcomes(_events(spark, sf)), 2, 3600.0).select("event_id", "state")


@query("st_breaker_stream", BREAKER)
def st_breaker_stream(spark, sf):
    return _drained(ops.breaker(_outcomes(_closed(spark, sf)), 2, 3600.0), "append").where("key >= 0").select("event_id", "state")


QUOTA = "SELECT event_id, user_id AS key, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 3 AS allowed FROM events"


@query("st_quota_events", QUOTA)
def st_quota_events(spark, sf):
    return ops.quota(_keyed(_events(spark, sf)), 86400, 3)


@query("st_quota_stream", QUOTA)
def st_quota_stream(spark, sf):
    return _drained(ops.quota(_keyed(_closed(spark, sf)), 86400, 3), "append").where("key >= 0")


# an item is in a cache of three if fewer than three others have been used since; what a use lets go is used in between and no more held
USED = """WITH u AS (SELECT event_id, user_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 l AS (SELECT a.event_id, a.user_id, b.item, max(b.i) AS last FROM u a JOIN u b ON b.user_id = a.user_id AND b.i < a.i AND b.item <> a.item GROUP BY ALL),
 p AS (SELECT a.event_id, max(b.i) AS own FROM u a JOIN u b ON b.user_id = a.user_id AND b.item = a.item AND b.i < a.i GROUP BY ALL),
 o AS (SELECT l.event_id, item, row_number() OVER (PARTITION BY l.event_id ORDER BY last DESC) AS place, own, count(*) FILTER (own IS NOT NULL AND last > own) OVER (PARTITION BY l.event_id) AS since FROM l LEFT JOIN p USING (event_id))
 SELECT u.event_id, user_id AS key, coalesce(item_gone, '') AS evicted FROM u LEFT JOIN (SELECT event_id, item AS item_gone FROM o WHERE place = 3 AND (own IS NULL OR since >= 3)) g USING (event_id)"""


def _uses(rows):
    return rows.select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("item"))


@query("st_lru_events", USED)
def st_lru_events(spark, sf):
    return ops.recently_used(_uses(_events(spark, sf)), 3).select("event_id", "key", F.array_join("evicted", ",").alias("evicted"))


@query("st_lru_stream", USED)
def st_lru_stream(spark, sf):
    out = _drained(ops.recently_used(_uses(_closed(spark, sf)), 3), "append").where("key >= 0")
    return out.select("event_id", "key", F.array_join("evicted", ",").alias("evicted"))


@query("st_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, s""")
def st_session(spark, sf):
    return ops.sessions(_events(spark, sf))


def _sessions(rows):
    return rows.select("event_id", F.when(F.col("user_id") < 0, "end").otherwise(F.col("event_type")).alias("key"), "ts", F.col("user_id").cast("string").alias("item"))


@query("st_session_registry")
def st_session_registry(spark, sf):
    """A registry of four sessions for each type of event, as a stream."""
    out = _drained(ops.session_registry(_sessions(_closed(spark, sf)), 4, 36_000.0), "append").where("key <> 'end'")
    return out.select("event_id", "key", F.array_join("gone", ",").alias("gone"))


@query("st_query_log", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def st_query_log(spark, sf):
    return ops.last_per_key(_events(spark, sf), "user_id", 20).select("user_id", "event_id")


@query("st_inflight_dedupe", "SELECT event_id AS request_id, min(event_id) OVER (PARTITION BY event_type || user_id) AS leader FROM events")
def st_inflight_dedupe(spark, sf):
    return ops.in_flight(_events(spark, sf).select(F.col("event_id").alias("request_id"), F.concat("event_type", F.col("user_id").cast("string")).alias("query")))


@query("st_usage_flush", "SELECT count(*) AS keys FROM (SELECT DISTINCT event_type || user_id FROM events)")
def st_usage_flush(spark, sf):
    e = _events(spark, sf).select(F.concat("event_type", F.col("user_id").cast("string")).alias("idempotency_key"))
    return ops.usage_once(e).agg(F.count("*").alias("keys"))


@query("st_tumbling", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark, sf):
    return ops.tumbling(_events(spark, sf))


@query("st_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def st_sliding(spark, sf):
    return ops.sliding(_events(spark, sf), "60 minutes", "30 minutes")


def _drained(df, mode: str):
    """What a stream gives until its source is drained: all its rows, or of a complete output the last state. Results and state lie in the shared folder."""
    spark, path = df.sparkSession, folder(df.sparkSession, "stream")
    run = ops.ingest(df, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/data/batch={i}"), f"{path}/state", mode, {"availableNow": True})
    try:
        run.awaitTermination()  # until the source is drained; a failure is raised here
    finally:
        run.stop()
    found = spark.read.schema(T.StructType([*df.schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/data")
    last = found.agg(F.max("batch")).first()[0]
    return (found.where(F.col("batch") == last) if mode == "complete" else found).drop("batch")


def _closed(spark, sf):
    """The stream of events, and then one of user -1 far in the future, which lets the watermark pass all others."""
    end = folder(spark, "closing")
    columns = _events(spark, sf)
    columns.limit(1).withColumns({"user_id": F.lit(-1).cast(columns.schema["user_id"].dataType), "event_id": F.lit(-1).cast("bigint"), "ts": F.lit("2100-01-01").cast(columns.schema["ts"].dataType)}).write.parquet(end)
    return _stream(spark, sf).unionByName(spark.readStream.schema(columns.schema).parquet(end))


def _stream(spark, sf):
    return spark.readStream.schema(_events(spark, sf).schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("st_ingest_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_ingest_stream(spark, sf):
    return _drained(_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("st_ttl", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM g)
 SELECT user_id AS key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, life""")
def st_ttl(spark, sf):
    """Through the stream, closed by an event of its own."""
    return _drained(ops.sliding_ttl(_closed(spark, sf).select("event_id", F.col("user_id").alias("key"), "ts"), 3600), "append").where("key >= 0")


@query("st_static_join", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def st_static_join(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return _drained(_stream(spark, sf).join(rich, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")), "complete")


@query("st_process", f"""WITH {DOCS}, e AS (SELECT path, hash || '+' AS hash, event_id AS seq, CASE event_type WHEN 'error' THEN 'unlink' ELSE 'change' END AS type FROM events JOIN docs ON doc_id = event_id // 4),
 l AS (SELECT path, hash, type FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) SELECT path, hash FROM docs WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT path, hash FROM l WHERE type <> 'unlink'""")
def st_process(spark, sf):
    """The corpus as a base and deltas, followed by a stream of events."""
    d = docs(spark, sf)
    kept = Deltas(spark, folder(spark, "corpus"), "path string, hash string")
    kept.start(d.select("path", "hash"))
    kind = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    e = _stream(spark, sf).withColumn("doc_id", F.floor(F.col("event_id") / 4)).join(d.select("doc_id", "path", "hash"), "doc_id")
    run = kept.follow(e.select("path", F.concat("hash", F.lit("+")).alias("hash"), F.col("event_id").alias("seq"), kind.alias("type")), {"availableNow": True})
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return kept.read()


@query("st_watch", "SELECT DISTINCT 'source=' || source || '/lang=' || lang AS folder, 'add' AS type FROM documents")
def st_watch(spark, sf):
    """The files of the documents' table, written in folders by source and language, as a watched folder tells them."""
    spark.dataSource.register(FolderEvents)
    place, state = folder(spark, "watched"), folder(spark, "listings")
    table(spark, sf, "documents").select("doc_id", "source", "lang").write.partitionBy("source", "lang").parquet(place)
    events = spark.readStream.format("folder_events").options(path=place, state=state, pattern="*.parquet").load()
    found = _drained(events, "append")
    return found.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), "type").distinct()
