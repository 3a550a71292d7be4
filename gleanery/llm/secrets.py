"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) come straight from the text and always stay.  Weak parts, long mixed
keys and endpoints, say little alone: they are exploded to intervals and joined with the strong parts
of the same text by scope (a window of code points, cut into cells so that the join is an equality
join on text and cell) and are reported only where the complementary parts co-occur.

Only texts with weak parts are joined, named by their MD5 digest, so copies are linked once and repeated
or null ids do no harm; all other rows are worked through where they lie.  Arrays of spans are built in
blocks, so the work of a text grows with its spans to the power 4/3 and not with their square.

Null texts count as empty; a text without spans has zero counts and empty span strings; repeated rows
give repeated results; an empty table gives an empty one.  Spans that start at the same place stand in
the order of KINDS. Columns that are kept may have any names; what an operator makes takes the place of
kept columns of its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

# The base patterns, and the least length of what is kept.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
# Weak parts, reported only beside their complements.
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
KINDS = ("assign", "access", "hex", "key", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"
SCOPE, BLOCK = 400, 128


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once; within a lambda an expression would be worked out anew for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, both) -> Column:
    """both(...) of each value of an array of int and all before it; in blocks, as an array that grows by one is copied each time."""

    def fold(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))

        def step(done: Column, x: Column) -> Column:
            return _let(both(done["now"], x), lambda now: F.struct(now.alias("now"), F.concat(done["out"], F.array(now)).alias("out")))

        return F.aggregate(block, start, step, lambda done: done["out"])

    zero = F.lit(0)

    def whole(known: Column) -> Column:
        last = F.floor((F.size(known) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(zero, last), lambda k: F.slice(known, k * BLOCK + 1, F.lit(BLOCK)))
        before = lambda of: fold(F.transform(of, lambda b: F.aggregate(b, zero, lambda x, y: both(x, y))), zero)
        shifted = lambda of: F.slice(F.concat(F.array(zero), before(of)), F.lit(1), F.size(of))
        return F.when(F.size(known) > BLOCK, _let(blocks, lambda of: F.flatten(F.zip_with(of, shifted(of), fold)))).otherwise(fold(known, zero))

    return _let(values, whole)


def _spans(text: Column, pattern: str, kind: int, found: Column) -> Column:
    """Spans of the matches found: between two matches lies what split() leaves."""
    sizes = F.transform(found, F.length)
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), sizes, lambda g, n: F.length(g) + n)
    spans = F.zip_with(_running(steps, lambda a, b: a + b), sizes, lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def parts(rows: DataFrame) -> DataFrame:
    """row, text (null: empty), base spans and weak spans, of rows (row, text) whatever row is; one pass over the text, no shuffle."""
    all_of = lambda pattern, when: F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    some = F.rlike("text", F.lit(r"[:=]"))
    one = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    two = one.select("*", all_of(ASSIGN, some).alias("assign"), all_of(ACCESS, F.contains("text", F.lit("AKIA"))).alias("access"), all_of(HEX, F.lit(True)).alias("hex"))
    strong = F.size("access") > 0
    three = two.select("*", all_of(KEY, strong).alias("key"), all_of(ENDPOINT, strong & F.contains("text", F.lit("://"))).alias("endpoint"))
    column = F.col("text")
    assign = F.zip_with(_spans(column, ASSIGN, 0, F.col("assign")), F.col("assign"), lambda s, m: F.struct(s.alias("s"), F.length(F.regexp_extract(m, ASSIGN, 2)).alias("n")))
    assign = F.transform(F.filter(assign, lambda x: x["n"] >= ASSIGN_LEAST), lambda x: x["s"])
    base = F.array_sort(F.concat(assign, _spans(column, ACCESS, 1, F.col("access")), _spans(column, HEX, 2, F.col("hex"))))
    weak = F.concat(_spans(column, KEY, 3, F.col("key")), _spans(column, ENDPOINT, 4, F.col("endpoint")))
    any_found = F.size("assign") + F.size("access") + F.size("hex") > 0
    none = F.array().cast(SPAN)
    return three.select("row", "text", F.when(any_found, base).otherwise(none).alias("base"), F.when(strong, weak).otherwise(none).alias("weak"))


def _text_key() -> Column:
    return F.md5(F.encode("text", "UTF-8")).alias("text_key")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """text_key and more, of texts (text_key, base, weak): the weak spans that lie within scope of their complements.

    A key needs an access identifier; an endpoint needs one, and an assigned secret or a key. Weak spans that
    overlap a base span are part of it. A span lies in all cells that it touches.
    """
    texts = found.where(F.size("weak") > 0).dropDuplicates(["text_key"])
    span = lambda s: [F.col(f"{s}.{x}").alias(x) for x in ("kind", "start", "end")]
    cells = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / scope) - b, F.floor((F.col("end") - 1) / scope) + b)))
    base = texts.select("text_key", F.explode("base").alias("p")).select("text_key", *span("p"))
    weak = texts.select("text_key", F.explode("weak").alias("w")).select("text_key", *span("w"))
    over = cells(base, "start", 0).select("text_key", "cell", F.col("start").alias("from"), F.col("end").alias("to"))
    covered = cells(weak, "start", 0).join(over, ["text_key", "cell"]).where("from < end and to > start").select("text_key", "kind", "start", "end").distinct()
    free = written(found.sparkSession, weak.join(covered, ["text_key", "kind", "start", "end"], "left_anti"), "weak")
    # a part lies in the cell of its start; a weak part looks into its own cell and both neighbours
    part = base.where("kind < 2").unionByName(free.where("kind = 3")).select("text_key", F.floor(F.col("start") / scope).alias("cell"), F.col("kind").alias("by"), F.col("start").alias("at"))
    look = free.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start") / scope) + d)))
    near = look.join(part, ["text_key", "cell"]).where((F.abs(F.col("at") - F.col("start")) <= scope) & (F.col("at") != F.col("start")))
    seen = near.groupBy("text_key", "kind", "start", "end").agg(F.max(F.col("by") == 1).alias("access"), F.max(F.col("by") != 1).alias("other"))
    return seen.where("access and (kind = 3 or other)").groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """keep and spans: array of (start, kind, end), by start, then kind as listed in KINDS; and base, those of the fixed patterns alone."""
    keep = tuple(c for c in keep if c not in ("base", "spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = parts(rows).select("row", "base", "weak", F.when(F.size("weak") > 0, _text_key()).alias("text_key"))
    found = written(df.sparkSession, found, "secrets")
    more = linked(found.select("text_key", "base", "weak"), scope)
    alone = found.where("text_key is null").select("row", "base", F.col("base").alias("spans"))
    joined = found.where("text_key is not null").join(more, "text_key", "left").select("row", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))
    return alone.unionByName(joined).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "base", "spans")


def _said(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(_said("base"), "UTF-8"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark.

    Pieces are cut from four bytes a code point, so that each costs its own length wherever it lies.
    """
    def whole(wide: Column) -> Column:
        piece = lambda at, n: F.decode(F.substring(wide, at * 4 + 1, n * 4), "UTF-32")

        def joined(ends: Column) -> Column:
            before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
            pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"] - at), F.lit(mark))).otherwise(F.lit("")))
            tail = F.element_at(ends, -1)
            return F.concat(F.array_join(pieces, ""), piece(tail, (F.octet_length(wide) / 4).cast("int") - tail))

        return _let(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined)

    return F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), whole)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with every span replaced by a mark and n_chars, where there is one, made to fit; rows without spans are untouched.

    The row travels as one struct, so its columns may have any names and types. Only rows with weak parts are shuffled.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = parts(rows)
    asked = parts(rows.select(F.lit(0).alias("row"), "text")).where(F.size("weak") > 0).select(_text_key(), "base", "weak")
    more = linked(written(docs.sparkSession, asked, "secrets"), scope)
    alone = found.where(F.size("weak") == 0).select("row", "text", F.col("base").alias("spans"))
    joined = found.where(F.size("weak") > 0).select("*", _text_key()).join(more, "text_key", "left").select("row", "text", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))
    done = alone.unionByName(joined).select("row", "spans", redacted(F.col("text"), F.col("spans")).alias("done"))
    touched = F.size("spans") > 0
    made = {text: F.when(touched, F.col("done")).otherwise(F.col(f"row.`{text}`"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(touched, F.length("done")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, digest of the base spans and all spans of every document; null texts count as empty."""
    return digest(scan(table(spark, sf_dir, "documents")))


def _op9_sql() -> str:
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    quote = lambda r: r.replace("'", "''")
    assign = quote(ASSIGN.replace("(?i)password|passwd|secret|token|api_?key", either).replace(r"\x20", " "))
    runs = "[A-Za-z0-9/+=]+"

    def spans(kind: int, pattern: str, keep: str = "true", where: str = "true") -> str:
        return f"""k{kind} AS (SELECT rid, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_split_to_array(t, '{pattern}')[:-2]) AS g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{pattern}') AND {where}),
s{kind} AS (SELECT rid, e - length(m) AS s, {kind} AS kind, e FROM (SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e FROM k{kind}) WHERE {keep})"""

    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    said = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    has_access = "rid IN (SELECT rid FROM s1)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{spans(0, assign, f"length(regexp_extract(m, '{assign}', 2)) >= {ASSIGN_LEAST}")},
{spans(1, ACCESS)},
{spans(2, HEX)},
base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
{spans(3, runs, "length(m) = 40 AND NOT contains(m, '=')", has_access)},
{spans(4, ENDPOINT, "true", has_access)},
weak AS (SELECT * FROM (SELECT * FROM s3 UNION ALL SELECT * FROM s4) w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND b.e > w.s)),
part AS (SELECT * FROM base WHERE kind < 2 UNION ALL SELECT * FROM weak WHERE kind = 3),
near AS (SELECT w.rid, w.s, w.kind, w.e FROM weak w JOIN part p ON p.rid = w.rid AND abs(p.s - w.s) <= 400 AND p.s <> w.s GROUP BY ALL HAVING bool_or(p.kind = 1) AND (w.kind = 3 OR bool_or(p.kind <> 1))),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {said} AS said FROM base GROUP BY rid),
a AS (SELECT rid, {said} AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM near) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.said, '')) AS base_sha256, coalesce(a.said, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


OP9_SQL = _op9_sql()
