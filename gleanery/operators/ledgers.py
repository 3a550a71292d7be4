"""Append-only ledgers: usage, audit, tool triggers, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.tables import written

# Dollars per million tokens (input, cached input, output); the first part of a model's name that fits decides, local models are free.
LOCAL = ("llama", "qwen", "mistral", "phi")
PRICES = (
    ("gemini-1.5-pro", 1.25, 0.3125, 5.0),
    ("gemini-1.5-flash", 0.075, 0.0375, 0.3),
    ("claude-3-5-sonnet", 3.0, 0.3, 15.0),
    ("claude-3.5-sonnet", 3.0, 0.3, 15.0),
    ("claude-3-5-haiku", 1.0, 0.1, 5.0),
    ("claude-3.5-haiku", 1.0, 0.1, 5.0),
    ("claude-3-opus", 15.0, 1.5, 75.0),
    ("gpt-4o-mini", 0.15, 0.075, 0.6),
    ("gpt-4o", 2.5, 1.25, 10.0),
    ("o1-preview", 15.0, 7.5, 60.0),
    ("o1-mini", 3.0, 1.5, 12.0),
    ("nomic-embed", 0.0, 0.0, 0.0),
    ("embed", 0.02, 0.02, 0.0),
)
# These cost twice as much beyond so many input tokens.
TIERED, TIER = ("gemini-1.5-pro", "gemini-1.5-flash"), 128_000


def cost(model: Column, fresh: Column, cached: Column, output: Column) -> Column:
    """Dollars; fresh counts all input tokens, those from the cache included. Null for unknown models."""
    name, total = F.lower(model), F.lit(None).cast("double")
    rest = F.greatest(fresh - cached, F.lit(0))
    for part, a, b, c in reversed(PRICES):
        price = (rest * a + cached * b + output * c) / 1e6
        if part in TIERED:
            price = F.when(fresh > TIER, price * 2).otherwise(price)
        total = F.when(F.contains(name, F.lit(part)), price).otherwise(total)
    for part in LOCAL:
        total = F.when(F.contains(name, F.lit(part)), 0.0).otherwise(total)
    return total


def record(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """The ledger with new events; a key that is there stays as it is, of equal new keys the earliest counts; failed events have no tokens."""
    first = events.groupBy("idempotency_key").agg(F.min(F.struct("created_at", *[c for c in events.columns if c not in ("idempotency_key", "created_at")])).alias("e")).select("idempotency_key", "e.*")
    ok = F.col("status") != "error"
    zeroed = first.select(*[F.when(ok, F.col(c)).otherwise(0).cast(first.schema[c].dataType).alias(c) if c.endswith("_tokens") else F.col(c) for c in ledger.columns])
    return ledger.unionByName(zeroed.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti").select(*ledger.columns))


def in_project(project: Column, wanted: str) -> Column:
    """Equal, or below a prefix that ends in /*."""
    return F.startswith(project, F.lit(wanted[:-1])) if wanted.endswith("/*") else project == wanted


def usage_summary(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_distinct("model").alias("models"), F.count_if(F.col("status") == "error").alias("errors"))


def usage_by_operation(usage: DataFrame) -> DataFrame:
    return usage.groupBy("operation").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def kept_since(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(at) >= cutoff)


def audit_page(rows: DataFrame, limit: int, most: int = 1000) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(limit, most))


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row an action, with shares of the whole from a second aggregate."""
    return rows.groupBy("action").agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def feedback_bias(feedback: DataFrame, results: DataFrame) -> DataFrame:
    """result_id and bias: 1 + 0.3 (share of positives - 0.5), 1 without feedback."""
    each = feedback.groupBy("result_id").agg(F.count_if(F.col("satisfaction") == "positive").alias("p"), F.count("*").alias("n"))
    return results.select("result_id").join(each, "result_id", "left").select("result_id", F.coalesce(F.round(1 + 0.3 * (F.col("p") / F.col("n") - 0.5), 6), F.lit(1.0)).alias("bias"))


def histogram(rows: DataFrame, label: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """label, le, count: cumulative buckets, +Inf the last; one pass, all buckets in one aggregate."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(label).agg(*aggs, F.count(value).alias("n"))
    each = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("count")))
    return wide.select(label, F.explode(each).alias("b")).select(label, "b.le", "b.count")


def degrees(links: DataFrame, limit: int = 15) -> DataFrame:
    ends = links.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "id").limit(limit)


def surprising(links: DataFrame, least: str = "INFERRED", limit: int = 40) -> DataFrame:
    rank = F.when(F.upper("confidence") == "EXTRACTED", 3).when(F.upper("confidence") == "INFERRED", 2).when(F.upper("confidence") == "AMBIGUOUS", 1).otherwise(0)
    low = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}[least]
    return links.where((rank >= low) & ~F.lower(F.coalesce("relation", F.lit(""))).isin("contains", "imports", "imports_from")).orderBy("source", "target").limit(limit)


def trigger_rates(rows: DataFrame, trigger: Column) -> DataFrame:
    """One row: how many calls an agent made of itself, how many a user asked for, and how many nobody has told of (null too)."""
    known = F.coalesce(trigger, F.lit(""))
    return rows.agg(F.count_if(known == "agent-auto").alias("agent_auto"), F.count_if(known == "user-explicit").alias("user_explicit"), F.count_if(~known.isin("agent-auto", "user-explicit")).alias("unknown"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """result_id with how often it was found positive, negative and neutral (satisfaction), and the total."""
    said = F.col("satisfaction")
    return feedback.groupBy("result_id").agg(*[F.count_if(said == s).alias(s) for s in ("positive", "negative", "neutral")], F.count("*").alias("total"))


def percentiles(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """by, and p50, p95, ...: the smallest value that so large a share of a label's values does not exceed.

    Equal values are counted before they meet, and the smallest value whose running count reaches the share is taken, so a label is
    never held whole; nulls don't count, a label of nulls alone has null.
    """
    n = rows.groupBy(by, value).agg(F.count(value).alias("_n"))
    at = cumulated(n.where(F.col(value).isNotNull()), by, value, "_n", "_upto")
    total = n.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_all"))
    reached = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(p) - 1e-9), F.col(value))).alias(f"p{round(p * 100)}") for p in points]
    # a label of nulls alone has a total of 0 and no row to meet
    return total.join(at, F.col("_by").eqNullSafe(F.col(by)), "left").groupBy(F.col("_by").alias(by)).agg(*reached)


def cumulated(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """rows with the running sum of a value in each group, by an order that is unique in it; nulls add nothing.

    The rows are sorted by group and order over all tasks and written once; a task's rows are summed for themselves, and what
    earlier tasks hold of the same group, a row for each task and group, is added. So a group that holds a third of all rows
    is spread over as many tasks as its share.
    """
    numbered = rows.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_task", F.spark_partition_id())
    held = written(numbered, "cumulated")
    sums = held.groupBy("_task", by).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("_before", before).select(F.col("_task").alias("_t"), F.col(by).alias("_g"), "_before")
    own = F.sum(value).over(Window.partitionBy("_task", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0).cast(rows.schema[value].dataType)
    summed = held.withColumn("_own", own).join(starts, (F.col("_task") == F.col("_t")) & F.col(by).eqNullSafe(F.col("_g")))
    return summed.withColumn(name, F.coalesce("_before", zero) + F.coalesce("_own", zero)).drop("_task", "_own", "_t", "_g", "_before")


def within_budget(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within a budget."""
    return cumulated(rows, by, order, size, "_used").where(F.col("_used") <= budget).drop("_used")


def communities(nodes: DataFrame) -> DataFrame:
    """community, size and sources (distinct source of its nodes)."""
    return nodes.groupBy("community").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"))


def command_digest(name: Column, path: Column, command: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, path, command), 256)


def untrusted(commands: DataFrame, trusted: DataFrame) -> DataFrame:
    """Commands (name, path, command) whose digest is not among the trusted ones (digest)."""
    rows = commands.withColumn("_digest", command_digest(F.col("name"), F.col("path"), F.col("command")))
    return rows.join(trusted.select(F.col("digest").alias("_digest")), "_digest", "left_anti").drop("_digest")


def placed(rows: DataFrame, by: str, value: Column, tie: str) -> DataFrame:
    """rows with place, from 1 in each group by value; those without a value come last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(value.asc_nulls_last(), tie)))
