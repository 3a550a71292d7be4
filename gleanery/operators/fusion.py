"""Fusion of ranked lists, reranking, blending, snippets and their deduplication, over batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import alike as sets
from gleanery.operators.lexical import BROADCAST_BYTES
from gleanery.operators.lexical import _sized as sized
from gleanery.sources.tables import spread, written

K, CUT = 60, 300
# bytes of parities in a block
SIGNS = 16 << 20


def structured(queries: DataFrame) -> DataFrame:
    """query_id, type, text and line of lines 'lex: …', 'vec: …', 'hyde: …'; other lines have an empty type."""
    lines = queries.select("query_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    return lines.select("query_id", F.lower(F.regexp_extract("raw", r"(?i)^\s*(lex|vec|hyde):", 1)).alias("type"), F.trim(F.regexp_replace("raw", r"(?i)^\s*(lex|vec|hyde):", "")).alias("text"), "line")


def list_weights(lists: DataFrame, doubled: int) -> DataFrame:
    """query_id, list_idx and weight: the first `doubled` lists that hold anything weigh 2, the others 1."""
    there = lists.select("query_id", "list_idx").distinct()
    order = Window.partitionBy("query_id").orderBy("list_idx")
    return there.withColumn("weight", F.when(F.row_number().over(order) <= doubled, 2.0).otherwise(1.0))


def _bonus(best: Column) -> Column:
    return F.when(best == 1, 0.05).when(best <= 3, 0.02).otherwise(0.0)


def rrf(lists: DataFrame, weights: DataFrame, k: int = K, cut: int = CUT) -> DataFrame:
    """query_id, file, score and rank: weighted reciprocal ranks with a bonus for the best rank; ties keep the order in which files were first seen."""
    part = lists.where(F.col("rank") <= cut).join(weights, ["query_id", "list_idx"])
    fused = part.groupBy("query_id", "file").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("base"), F.min("rank").alias("best"), F.min(F.struct("list_idx", "rank")).alias("seen"))
    scored = fused.select("query_id", "file", F.round(F.col("base") + _bonus(F.col("best")), 9).alias("score"), "seen")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return scored.withColumn("rank", F.row_number().over(order)).drop("seen")


def rrf_trace(lists: DataFrame, weights: DataFrame, k: int = K) -> DataFrame:
    """query_id, file, contributions (in list order), base, bonus and total; lists are not cut."""
    part = lists.join(weights, ["query_id", "list_idx"]).withColumn("c", F.struct("list_idx", "rank", "weight", F.round(F.col("weight") / (k + F.col("rank")), 9).alias("contribution")))
    each = part.groupBy("query_id", "file").agg(F.array_sort(F.collect_list("c")).alias("contributions"), F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("base"), F.min("rank").alias("best"))
    return each.select("query_id", "file", "contributions", "base", _bonus(F.col("best")).alias("bonus"), F.round(F.col("base") + _bonus(F.col("best")), 9).alias("total"))


def top(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def with_neighbours(ranked: DataFrame, near: DataFrame, score: float = 0.1) -> DataFrame:
    """Candidates with graph neighbours (query_id, file) after them, at a flat score."""
    last = ranked.groupBy("query_id").agg(F.max("rank").alias("last"))
    fresh = near.select("query_id", "file").distinct().join(ranked, ["query_id", "file"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("file")
    added = fresh.withColumn("_n", F.row_number().over(order)).join(last, "query_id").select("query_id", "file", F.lit(score).alias("score"), (F.col("last") + F.col("_n")).alias("rank"))
    return ranked.unionByName(added)


def best_chunk(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """For each candidate (query_id, file) the chunk (file, seq, text; one row for each file and seq) with most distinct words of its query (text), the first at a tie.

    Places are compared as numbers, most words first; texts meet their candidates and are joined once more where they are chosen, but are not sorted.
    """
    terms = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda t: F.length(t) > 2))
    asked = queries.select("query_id", F.col("text").alias("query")).select("query_id", terms.alias("terms"))
    pairs = candidates.select("query_id", "file").join(asked, "query_id").join(chunks, "file")
    overlap = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("text")), t)))
    place = F.lit(1 << 31) - 1 - F.col("seq") + F.shiftleft(overlap.cast("bigint"), 31)
    best = pairs.groupBy("query_id", "file").agg(F.max(place).alias("_p"))
    best = best.select("query_id", "file", (F.lit((1 << 31) - 1) - F.col("_p").bitwiseAND((1 << 31) - 1)).cast("int").alias("seq"), F.shiftright("_p", 31).cast("int").alias("overlap"))
    return best.join(chunks.select("file", "seq", "text"), ["file", "seq"]).select("query_id", "file", "seq", "overlap", "text")


def overlap_score(query: Column, text: Column) -> Column:
    """The default rerank score: the share of the query's words that the text holds."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.length(t) > 2))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.size(terms)).otherwise(0.0)


def rerank(pairs: DataFrame, cache: DataFrame | None = None, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """pairs (query_id, file, query, chunk) with rerank: equal pairs are scored once, and only if the cache (key, score) lacks them."""
    keyed = pairs.withColumn("key", F.sha2(F.to_json(F.struct(F.col("chunk").alias("chunk"), F.col("query").alias("query"))), 256))
    wanted = keyed.select("key", "query", "chunk").dropDuplicates(["key"])
    known = cache.select("key", "score") if cache is not None else None
    missing = wanted.join(known, "key", "left_anti") if known is not None else wanted
    score = F.pandas_udf(scorer, "double")("query", "chunk") if scorer else overlap_score(F.col("query"), F.col("chunk"))
    scored = missing.select("key", score.alias("score"))
    if known is not None:
        scored = scored.unionByName(known.join(wanted, "key", "left_semi"))
    return keyed.join(scored, "key").drop("key").withColumnRenamed("score", "rerank")


def blend(rank: Column, rerank_score: Column) -> Column:
    """Rank and rerank score, the rank weighing less further down."""
    weight = F.when(rank <= 3, 0.75).when(rank <= 10, 0.6).otherwise(0.4)
    return weight * F.greatest(F.lit(0.01), F.exp(-(rank - 1) / 5.5)) + (1 - weight) * rerank_score


def final(blended: DataFrame, least: float, limit: int) -> DataFrame:
    """query_id, file, score and place: each file once at its best, those of least score and the first `limit`."""
    once = blended.groupBy("query_id", "file").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 2))


def _cell(a: Column, b: Column) -> Column:
    """Where sets of two blocks meet, whichever comes first."""
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def _alike(rows: DataFrame, t: Column, least: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """similar_sets() within groups (by): the pairs of distinct sets, and the copies.

    Exact, by prefixes: two sets that are alike share one of their rarest tokens, as many as may be missing and one more, so sets meet by
    these alone. Rare is told by counters of hashes; any order that is the same for all sets gives the same pairs. Pairs are pairs of numbers: whole sets are
    neither stored nor moved for each pair. Parities of tokens (a bit for each token, about) meet the pairs block by block and leave hardly any that is not alike; then the rows that
    are in a pair are read once more, and their sets meet the pairs in cells that sets of a group share, so that a set goes to few of them. Tokens are compared by 64 bits of hash.
    """
    kind = lambda some, names: "".join(f"`{c}` {some.schema[c].dataType.simpleString()}, " for c in names)
    hashed = F.sort_array(F.transform(t, lambda x: F.xxhash64(x))).alias("t")
    named = rows.where("doc_id is not null")
    seen = written(named.select(*by, "doc_id", hashed).mapInArrow(sets.counted, f"{kind(rows, [*by, 'doc_id'])}digest binary, c int, n bigint"), "digests")
    often = sets.levels(seen.where("c is not null").groupBy("c").agg(F.sum("n").alias("n")).toArrow())
    ids = seen.where("digest is not null").select(*by, "doc_id", "digest")
    first = ids.groupBy(*by, "digest").agg(F.min("doc_id").alias("a"))
    copies = sized(ids.join(first, [*by, "digest"]).where("doc_id > a").select(*by, "a", F.col("doc_id").alias("b"), "digest"), "copies")
    made = named.select(*by, F.col("doc_id").alias("a"), hashed).mapInArrow(sets.prefixes(often, least), f"{kind(rows, by)}a {rows.schema['doc_id'].dataType.simpleString()}, digest binary, n int, tokens array<bigint>, signs binary")
    made = made.join(copies.select(*by, F.col("b").alias("a"), "digest"), [*by, "a", "digest"], "left_anti")
    if not ids.groupBy(*by, "doc_id", "digest").count().where("count > 1").isEmpty():
        made = made.dropDuplicates([*by, "a", "digest"])
    prefix = written(made.withColumn("i", F.monotonically_increasing_id()), "prefixes")

    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    posts = prefix.select("i", group.alias("g"), "n", "tokens").mapInArrow(sets.postings(often), "key bigint, i bigint, n int, at int, p bigint, q bigint")
    pairs = posts.repartition("key").sortWithinPartitions("key", "n").mapInArrow(sets.pairs(least), "i bigint, j bigint")
    size = prefix.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.octet_length("signs")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, min(6, size["sets"] // sets.BLOCK), -(-size["bytes"] // SIGNS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    each = prefix.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("other"), "i", "n", "signs")
    each = each.select(_cell(block("i"), F.col("other")).alias("cell"), "i", F.lit(None).cast("bigint").alias("j"), "n", "signs")
    asked = each.unionByName(pairs.select(_cell(block("i"), block("j")).alias("cell"), "i", "j"), allowMissingColumns=True)
    near = written(asked.repartition("cell").sortWithinPartitions("cell", F.col("j").asc_nulls_first(), "i").mapInArrow(sets.likely(least), "i bigint, j bigint"), "near")

    # a set goes with the first one it is near to; groups of many sets or tokens are cut into blocks, and small ones share a block
    ends = near.select("i", F.col("i").alias("label")).unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("label"))).groupBy("i").agg(F.min("label").alias("label"))
    members = written(ends.join(prefix.select("i", *by, "a", "digest", "n"), "i"), "members")
    parts = F.ceil(F.greatest(F.count("*") / sets.MEMBERS, F.sum("n") / sets.TOKENS))
    large = sized(members.groupBy("label").agg(parts.alias("parts")).where("parts > 1"), "large")
    shared = F.pmod(F.xxhash64("label"), F.lit(1 + members.count() // 256))
    placed = sized(members.join(large, "label", "left").select("i", F.when(F.col("parts") > 1, F.xxhash64("label", F.pmod(F.xxhash64("i"), F.col("parts")))).otherwise(shared).alias("block")), "placed")
    told = near.join(placed.withColumnRenamed("block", "u"), "i").join(placed.select(F.col("i").alias("j"), F.col("block").alias("v")), "j").select(_cell(F.col("u"), F.col("v")).alias("cell"), "i", "j")
    cells = told.select("cell", F.explode(F.array("i", "j")).alias("i")).distinct().groupBy("i").agg(F.collect_list("cell").alias("cells"))
    wanted = written(cells.join(members.drop("label", "n"), "i"), "wanted")
    if (wanted.agg(F.sum(64 + 8 * F.size("cells"))).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    else:
        # ids alone may yet be small enough, so that only texts of near sets are moved
        named = named.join(sized(wanted.select(*by, F.col("a").alias("doc_id")), "wanted-ids"), [*by, "doc_id"], "left_semi")
    again = named.join(wanted.withColumnRenamed("a", "doc_id"), [*by, "doc_id"]).select("cells", "i", *by, F.col("doc_id").alias("a"), "digest", hashed)
    again = again.select(F.explode("cells").alias("cell"), "i", F.lit(None).cast("bigint").alias("j"), *by, "a", "digest", "t")
    meet = again.unionByName(told, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", F.col("j").asc_nulls_first())
    alike = meet.mapInArrow(sets.verified(least, by), f"{kind(rows, by)}a {rows.schema['doc_id'].dataType.simpleString()}, b {rows.schema['doc_id'].dataType.simpleString()}, jaccard double")
    return alike.withColumn("jaccard", F.round("jaccard", 6)), copies.select(*by, "a", "b", F.lit(1.0).alias("jaccard"))


def similar_sets(rows: DataFrame, least: float, t: Column | None = None) -> DataFrame:
    """a, b and jaccard of the rows (doc_id) whose sets of tokens, t, are alike by `least` or more: pairs of distinct sets, each named by its smallest id, and each copy with that id."""
    alike, copies = _alike(rows, F.col("t") if t is None else t, least, [])
    return alike.unionByName(copies)


def snippet_dedup(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Results (query_id, place, snippet) without those too like one kept before them in their query.

    Lists of any length: what is alike comes from _alike(). Of what is alike, all that has nothing undecided before it is kept, and what is like
    it goes; again until nothing is undecided, as many rounds as a chain of such decisions is long. Copies of a snippet share its lot or go for it.
    """
    rows = written(results.select("query_id", F.col("place").alias("doc_id"), "snippet"), "snippets")
    pairs, copies = _alike(rows, token_set(F.col("snippet")), threshold, ["query_id"])
    node = ["query_id", "place"]
    gone = copies.select("query_id", F.col("b").alias("place"))
    left = written(pairs.select("query_id", "a", "b"), "open")
    while not left.isEmpty():
        later = left.select("query_id", F.col("b").alias("place")).distinct()
        kept = left.select("query_id", F.col("a").alias("place")).distinct().join(later, node, "left_anti")
        out = written(left.join(kept.withColumnRenamed("place", "a"), ["query_id", "a"], "left_semi").select("query_id", F.col("b").alias("place")).distinct(), "out")
        gone = gone.unionByName(out)
        for end in ("a", "b"):
            left = left.join(out.withColumnRenamed("place", end), ["query_id", end], "left_anti")
        # what is kept has no open pair left: all that is like it is out
        left = written(left.select("query_id", "a", "b"), "open")
    return results.join(gone.distinct(), node, "left_anti")


def federated(results: DataFrame, limit: int) -> DataFrame:
    """Results of several indexes (query_id, index, docid, score): each document at its best score, the first `limit`."""
    best = results.groupBy("query_id", "docid").agg(F.max(F.struct("score", "index")).alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.desc("b.score"), "docid")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "docid", F.round("b.score", 2).alias("score"), F.col("b.index").alias("index"), "place")


def query_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: F.length(t) > 2)


def arch_hints(queries: DataFrame, hints: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """Hints (hint_id, kind, title, body) for queries (query_id, text) of the same graph, which `by` names, by words they hold and a bonus by kind.

    A word of a query has only a-z, 0-9 and _, so it stands within a run of these. Each text is lower-cased and cut once: the parts of its distinct
    runs, of the lengths that words have, meet the words as equal keys. So work grows with the texts and the hits, not with texts times words.
    """
    asked = queries.select("query_id", *by, query_words(F.col("text")).alias("q")).where(F.size("q") > 0)
    asked = written(asked.withColumn("_q", F.monotonically_increasing_id()), "asked")
    terms = sized(asked.select(*by, "_q", F.explode("q").alias("term")).groupBy(*by, "_q", "term").agg(F.count("*").alias("times")), "terms")
    lengths = terms.agg(F.sort_array(F.collect_set(F.length("term"))).alias("n")).first()["n"]
    lengths = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    hay = F.lower(F.concat_ws(" ", "title", "body"))
    bonus = F.when(F.col("kind") == "god_node", 0.2).when(F.col("kind") == "surprising_edge", 0.15).otherwise(0.0)
    cuts = lambda run, n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))
    parts = lambda run: F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(run)), lambda n: cuts(run, n)))
    runs = F.array_distinct(F.regexp_extract_all(hay, F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    rows = spread(hints).select("hint_id", "kind", *by, F.monotonically_increasing_id().alias("_h"), F.array_distinct(F.flatten(F.transform(runs, parts))).alias("parts"))
    held = rows.select("hint_id", "kind", *by, "_h", F.explode("parts").alias("term")).join(terms, [*by, "term"])
    scored = held.groupBy("_q", "_h", "hint_id", "kind").agg(F.sum("times").alias("n")).select("_q", "hint_id", "kind", (F.col("n") + bonus).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "hint_id")
    first = lambda some: some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "hint_id", "kind", "score", "place")
    best = written(first(scored.join(F.broadcast(asked.select("_q", "query_id")), "_q")), "best")
    few = asked.join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit).drop("n")
    if few.isEmpty():
        return best
    # fewer hints than asked for hold a word of these queries, so of this many with the greatest bonus enough are left that hold none
    extra = Window.partitionBy(*by).orderBy(F.desc("bonus"), "hint_id")
    idle = hints.withColumn("bonus", bonus).where("bonus > 0").withColumn("_r", F.row_number().over(extra)).where(F.col("_r") < 2 * limit).drop("_r")
    none = few.join(F.broadcast(idle.withColumn("hay", hay)), by).where(~F.exists("q", lambda t: F.contains(F.col("hay"), t)))
    return first(best.drop("place").unionByName(none.select("query_id", "hint_id", "kind", F.col("bonus").alias("score"))))


def expansion(queries: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """query_id, type and text: the query itself if it is short; else the generated lines that hold a word of it; else three plain variants."""
    terms = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: F.length(t) > 0)
    asked = queries.select("query_id", "text", F.size(terms).alias("n"), terms.alias("terms"))
    short = asked.where("n <= 3").select("query_id", F.explode(F.array(F.struct(F.lit("lex").alias("type"), "text"), F.struct(F.lit("vec").alias("type"), "text"))).alias("x")).select("query_id", "x.type", "x.text")
    long = asked.where("n > 3")
    lines = None
    if generated is not None:
        raw = structured(generated).where("type <> ''").select("query_id", "type", F.col("text").alias("line"))
        lines = raw.join(long, "query_id").where(F.exists("terms", lambda t: F.contains(F.lower(F.col("line")), t))).select("query_id", "type", F.col("line").alias("text"))
        long = long.join(lines.select("query_id").distinct(), "query_id", "left_anti")
    plain = F.array(F.struct(F.lit("hyde").alias("type"), F.concat(F.lit("Information about "), "text").alias("text")), F.struct(F.lit("lex").alias("type"), F.col("text")), F.struct(F.lit("vec").alias("type"), F.col("text")))
    out = short.unionByName(long.select("query_id", F.explode(plain).alias("x")).select("query_id", "x.type", "x.text"))
    return out.unionByName(lines) if lines is not None else out


def ranked_lists(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """Rows of query_id and list_idx with their rank by a key, the first `most` of each list; a task hands on no more than these of its own."""
    order = Window.partitionBy("query_id", "list_idx").orderBy(key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rerank_ms(n: Column) -> Column:
    """About how long reranking n candidates takes: 400 ms, and 500 each, less the more there are beyond 20, but no less than 200."""
    return 400 + n * F.when(n > 20, 500 - F.least(F.lit(300), 5 * (n - 20))).otherwise(500)


def setting(default: int, *sources: Column) -> Column:
    """The first of several sources (request, environment, collection, ...) that says anything, else the default."""
    return F.coalesce(*sources, F.lit(default))
