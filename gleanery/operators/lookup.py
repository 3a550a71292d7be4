"""Finding documents by id, path, glob or likeness; contexts by path prefix; line ranges and diffs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.lexical import _sized as sized
from gleanery.sources.tables import ranked, spread, written


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ** crosses folders, * and ? do not, [] and {} as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def by_docid(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and the smallest path whose hash begins with `wanted` (six digits or more, any case); joined on the first six digits."""
    q = queries.select("query_id", F.lower("wanted").alias("w")).where(F.length("w") >= 6).withColumn("k", F.substring("w", 1, 6))
    d = docs.select("hash", "path", F.substring("hash", 1, 6).alias("k"))
    return d.join(q, "k").where(F.startswith("hash", F.col("w"))).groupBy("query_id").agg(F.min("path").alias("path"))


def find(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, priority and path of what `name` means: 1 a #docid, 2 collection and path, 3 a path, 4 the end of a path. Equality joins, the file name for the last."""
    d = docs.select("collection", "path", "hash")
    q = queries.select("query_id", "name")
    one = q.where(F.startswith("name", F.lit("#"))).withColumn("k", F.lower(F.substring("name", 2, 6))).join(d.withColumn("k", F.substring("hash", 1, 6)), "k").select("query_id", F.lit(1).alias("priority"), "path")
    two = q.join(d.withColumn("name", F.concat_ws("/", "collection", "path")), "name").select("query_id", F.lit(2).alias("priority"), "path")
    three = q.join(d.withColumn("name", F.col("path")), "name").select("query_id", F.lit(3).alias("priority"), "path")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    four = q.withColumn("file", last(F.col("name"))).join(d.withColumn("file", last(F.col("path"))), "file").where(F.endswith("path", F.concat(F.lit("/"), "name"))).select("query_id", F.lit(4).alias("priority"), "path")
    best = one.unionByName(two).unionByName(three).unionByName(four).groupBy("query_id").agg(F.min(F.struct("priority", "path")).alias("b"))
    return best.select("query_id", "b.priority", "b.path")


SHORT = 32


def _shortened(text: Column, most: int) -> Column:
    """text and all that is left of it without `most` characters at most, as 64-bit hashes of distinct strings."""
    all_, last = F.array(text), F.array(text)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        all_ = F.concat(all_, last)
    return F.array_distinct(F.transform(all_, lambda s: F.xxhash64(s)))


def _within(q: DataFrame, paths: DataFrame, edits: int) -> DataFrame:
    """query_id, path and distance of all paths that are within so many edits of `wanted`."""
    short, long = paths.where(F.length("path") <= SHORT), paths.where(F.length("path") > SHORT)
    keys = q.where(F.length("wanted") <= SHORT + edits).select("query_id", F.explode(_shortened(F.col("wanted"), edits)).alias("k"))
    # q, a row a query, is met again by its id to verify; keys are moved without their texts
    met = short.select("path", F.explode(_shortened(F.col("path"), edits)).alias("k")).join(sized(keys, "keys"), "k").select("query_id", "path").distinct()
    near = met.join(q, "query_id").unionByName(_by_segments(q.where(F.length("wanted") > SHORT - edits), long, edits))
    return near.withColumn("distance", F.levenshtein("path", "wanted", edits)).where("distance >= 0").select("query_id", "path", "distance").distinct()


def _by_segments(q: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """query_id, path and wanted of long paths that share a segment with `wanted` about where it stands: a path is cut into most + 1 parts of about
    equal length; as many edits leave one of them as it is, at most places away. A path gives most + 1 rows, a query a number that does not depend on them."""
    parts = most + 1
    at = lambda n, i: F.floor(n * i / parts).cast("int")
    part = lambda c, n, i, start: F.substring(c, start + 1, at(n, i + 1) - at(n, i))
    n = F.length("path")
    cut = paths.select("path", F.explode(F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), part(F.col("path"), n, i, at(n, i)).alias("text")) for i in range(parts)])).alias("k"))
    q = q.withColumn("n", F.explode(F.sequence(F.greatest(F.length("wanted") - most, F.lit(0)), F.length("wanted") + most)))
    q = q.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    start = at(F.col("n"), F.col("i")) + F.col("shift")
    held = q.where(start >= 0).select("query_id", "wanted", F.struct("n", "i", part(F.col("wanted"), F.col("n"), F.col("i"), start).alias("text")).alias("k")).distinct()
    return cut.join(held, "k").select("query_id", "path", "wanted").distinct()


def similar_paths(queries: DataFrame, docs: DataFrame, most: int, limit: int) -> DataFrame:
    """query_id, path and distance of the distinct paths nearest to `wanted` by edits, `most` at most.

    Edit by edit: a query that has found `limit` paths within some edits needs none that are farther; the others go on. Two texts within d edits
    have what is left of each without d characters at most in common, so they are joined by that and verified; paths of one folder do not meet for
    being in it. Paths over SHORT characters, which would leave too many texts, are joined by segments they share.
    """
    # short rows make many keys each: they are dealt to all cores
    paths = spread(written(docs.select("path").where("path is not null").distinct(), "paths"))
    left = written(queries.select("query_id", "wanted").where("wanted is not null"), "asked")
    order, found = Window.partitionBy("query_id").orderBy("distance", "path"), None
    for edits in range(min(most, 1), most + 1):
        near = _within(spread(left), paths, edits).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
        near = written(near, "near")
        done = near.where(F.col("_r") == limit).select("query_id") if edits < most else left.select("query_id")
        settled = near.join(done, "query_id", "left_semi").drop("_r")
        found = settled if found is None else found.unionByName(settled)
        if edits < most:
            left = written(left.join(done, "query_id", "left_anti"), "asked")
            if left.isEmpty():
                break
    return found


def line_range(body: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(F.split(body, "\n"), first, count), "\n")


def parse_virtual(path: Column) -> Column:
    """collection and path of scheme://collection/path; null where a part climbs up."""
    pattern = r"^[a-z]+://([^/]+)/*(.*)$"
    rest = F.regexp_extract(path, pattern, 2)
    return F.when(path.rlike(pattern) & ~rest.rlike(r"(^|/)\.\.(/|$)"), F.struct(F.regexp_extract(path, pattern, 1).alias("collection"), rest.alias("path")))


def matching_contexts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Documents with each context whose prefix their path begins with; contexts are settings, a short list that is broadcast."""
    c = F.broadcast(contexts.select(F.col("collection").alias("c"), "prefix", "context"))
    return docs.join(c, (F.col("c").isNull() | (F.col("c") == F.col("collection"))) & F.startswith("path", F.col("prefix")))


def inherited_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """All contexts of a document, the general first."""
    each = matching_contexts(docs, contexts).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("c").isNotNull().alias("own"), F.length("prefix").alias("n"), "context"))).alias("l"))
    return each.select("doc_id", F.array_join("l.context", "\n\n").alias("context"))


def best_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The context of the longest prefix, a collection's before the global one."""
    best = matching_contexts(docs, contexts).groupBy("doc_id").agg(F.max(F.struct(F.col("c").isNotNull(), F.length("prefix"), "context")).alias("b"))
    return best.select("doc_id", "b.context")


def missing_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Collections and top folders that no context of the collection covers."""
    top = lambda c: F.substring_index(c, "/", 1)
    folders = docs.select("collection", top("path").alias("folder")).distinct()
    whole = contexts.where("prefix = ''").select("collection")
    part = contexts.where("prefix <> ''").select("collection", top("prefix").alias("folder"))
    return folders.join(whole, "collection", "left_anti").join(part, ["collection", "folder"], "left_anti")


def with_contexts(contexts: DataFrame, changes: DataFrame) -> DataFrame:
    """contexts after changes (collection, prefix, context): a null context takes one away, others are added or replace what is there.

    A null collection is the global one. Of changes to one place the greatest context holds, null only if it is the only one.
    """
    same = lambda a, b: a["collection"].eqNullSafe(b["collection"]) & (a["prefix"] == b["prefix"])
    last = changes.groupBy("collection", "prefix").agg(F.max("context").alias("context"))
    held = contexts.alias("held")
    return held.join(last.alias("new"), same(contexts, last), "left_anti").unionByName(last.where("context is not null"))


def listed_contexts(contexts: DataFrame) -> DataFrame:
    """collection, prefix, context and place (from 1) of the contexts of collections, the longest prefix of each first."""
    rows = contexts.where("collection is not null").withColumn("_shorter", -F.length("prefix"))
    return ranked(rows, "collection", "_shorter", "prefix", name="contexts").select("collection", "prefix", "context", (F.col("_at") + 1).alias("place"))


def active(docs: DataFrame) -> DataFrame:
    return docs.where("active")


def in_collections(docs: DataFrame, names: list[str]) -> DataFrame:
    """Documents of some collections; of all if none is named."""
    return docs.where(F.col("collection").isin(*names)) if names else docs


def default_collections(collections: DataFrame) -> DataFrame:
    """The collections (collection, by_default) that a query without a list of its own asks; one that does not say so is asked."""
    return collections.where(F.coalesce("by_default", F.lit(True))).select("collection").distinct()


def listed_files(docs: DataFrame, collection: str, prefix: str = "") -> DataFrame:
    """doc_id, path, size (characters) and modified_at of the active documents of a collection under a prefix."""
    under = active(docs).where((F.col("collection") == collection) & F.startswith("path", F.lit(prefix)))
    return under.select("doc_id", "path", F.length("body").alias("size"), "modified_at")


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")


def staleness(known: DataFrame, disk: DataFrame) -> DataFrame:
    """missing, stale (newer on disk by more than a second) or fresh."""
    state = F.when(F.col("disk_mtime").isNull(), "missing").when(F.col("disk_mtime") > F.col("mtime") + 1, "stale").otherwise("fresh")
    return known.join(disk, "doc_id", "left").select("doc_id", state.alias("state"))


def line_changes(pairs: DataFrame, key: str) -> DataFrame:
    """Lines added and deleted between old and new, counted as multisets."""
    side = lambda c, d: pairs.select(key, F.explode(F.split(c, "\n")).alias("line"), F.lit(d).alias("d"))
    net = side("old", -1).unionByName(side("new", 1)).groupBy(key, "line").agg(F.sum("d").alias("d"))
    return net.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("added"), F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0)).alias("deleted"))


def line_diff(pairs: DataFrame, key: str, context: int = 3) -> DataFrame:
    """Unified diff of old and new with lines added and deleted."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, old, new in zip(batch[key], batch["old"], batch["new"], strict=True):
                lines = list(difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), n=context, lineterm=""))[2:]
                rows.append((k, "\n".join(lines), sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines)))
            yield pd.DataFrame(rows, columns=[key, "diff", "added", "deleted"])

    return pairs.select(key, "old", "new").mapInPandas(run, f"{key} {kind}, diff string, added bigint, deleted bigint")


def index_list(docs: DataFrame, index: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """name and documents of each index, but for those that were taken away."""
    rows = docs.select(index.alias("name")).where(~F.col("name").isin(*without)) if without else docs.select(index.alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("documents"))


def first_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order that ends in a unique column, with place from 1; each task hands on `limit` rows at most."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
