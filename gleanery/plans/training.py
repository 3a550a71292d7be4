"""Queries of the training-data operators.

Queries and expansions are made of the benchmark's whole texts, eight words a row: the first four ask, the first
gives the lex line, all eight the vec line and, said twice, the hyde line. Every third row asks for lex alone,
every fourth has a line without a head.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import training as tr
from gleanery.plans.catalog import query, table

ROWS = """ps AS (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark),
 m AS (SELECT item_id * 100000 + i AS item_id, w[i * 8 + 1:i * 8 + 8] AS w FROM (SELECT item_id, w, unnest(range(0, (len(w) + 7) // 8)) AS i FROM ps)),
 r AS (SELECT item_id, array_to_string(w[1:4], ' ') || CASE item_id % 3 WHEN 0 THEN ' /only:LEX' ELSE '' END AS query,
 'lex: ' || w[1] || ' guide' || chr(10) || 'vec: ' || array_to_string(w, ' ') || chr(10) || chr(10) || CASE item_id % 4 WHEN 0 THEN 'bad line' ELSE 'hyde: ' || array_to_string(w, ' ') || ' ' || array_to_string(w, ' ') END AS expansion FROM m)"""


def _rows(spark, sf):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    parts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 8).cast("int"))
    m = table(spark, sf, "benchmark").select("item_id", words.alias("w"), F.explode(parts).alias("i"))
    m = m.select((F.col("item_id") * 100000 + F.col("i")).alias("item_id"), F.slice("w", F.col("i") * 8 + 1, F.lit(8)).alias("w"))
    said, k = F.array_join("w", " "), F.col("item_id")
    q = F.concat(F.array_join(F.slice("w", 1, 4), " "), F.when(k % 3 == 0, " /only:LEX").otherwise(""))
    last = F.when(k % 4 == 0, "bad line").otherwise(F.concat(F.lit("hyde: "), said, F.lit(" "), said))
    return m.select("item_id", q.alias("query"), F.concat(F.lit("lex: "), F.col("w")[0], F.lit(" guide\nvec: "), said, F.lit("\n\n"), last).alias("expansion"))


@query("tr_parse", f"WITH {ROWS}, l AS (SELECT item_id, trim(unnest(string_split(expansion, chr(10)))) AS line FROM r) SELECT item_id, CASE WHEN regexp_matches(line, '^(lex|vec|hyde):') THEN string_split(line, ':')[1] ELSE 'invalid' END AS kind, trim(regexp_replace(line, '^(lex|vec|hyde):', '')) AS value FROM l WHERE line <> ''")
def tr_parse(spark, sf):
    return _rows(spark, sf).select("item_id", F.explode(tr.parse(F.col("expansion"))).alias("p")).select("item_id", "p.kind", "p.value")


@query("tr_only_mode", f"WITH {ROWS} SELECT item_id, nullif(lower(regexp_extract(query, '(?i)\\s+/only:(lex|vec|hyde)\\s*$', 1)), '') AS only, trim(regexp_replace(query, '(?i)\\s+/only:(lex|vec|hyde)\\s*$', '')) AS query FROM r")
def tr_only_mode(spark, sf):
    return _rows(spark, sf).select("item_id", tr.only_mode(F.col("query")).alias("m")).select("item_id", "m.only", "m.query")


@query("tr_clean", "SELECT conv_id, turn, trim(replace(regexp_replace('<think>a' || chr(10) || 'b</think> ' || text || '<|im_end|>', '(?s)<think>.*?</think>', '', 'g'), '<|im_end|>', '')) AS text, true AS thought FROM conversations")
def tr_clean(spark, sf):
    c = tr.clean(F.concat(F.lit("<think>a\nb</think> "), "text", F.lit("<|im_end|>")))
    return table(spark, sf, "conversations").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.text", "c.thought")


LOW = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
TERMS = "[" + ", ".join(f"'{w}'" for w in sorted(tr.TERM_STOP)) + "]"


@query("tr_key_terms", f"WITH {ROWS} SELECT item_id, array_to_string(list_sort(list_filter({LOW.format('query')}, lambda w: NOT list_contains({TERMS}, w))), ' ') AS terms FROM r")
def tr_key_terms(spark, sf):
    return _rows(spark, sf).select("item_id", F.array_join(F.array_sort(tr.key_terms(F.col("query"))), " ").alias("terms"))


@query("tr_terms_kept", f"WITH {ROWS}, t AS (SELECT item_id, list_filter({LOW.format('query')}, lambda w: NOT list_contains({TERMS}, w)) AS t, {LOW.format('expansion')} AS e FROM r) SELECT item_id, len(t) = 0 OR list_has_any(t, e) AS kept FROM t")
def tr_terms_kept(spark, sf):
    return _rows(spark, sf).select("item_id", tr.keeps_terms(F.col("expansion"), F.col("query")).alias("kept"))


@query("tr_entities_kept", f"WITH {ROWS} SELECT item_id, contains(lower(expansion), lower(left(query, 4))) OR contains(lower(expansion), 'zzz') AS kept FROM r")
def tr_entities_kept(spark, sf):
    return _rows(spark, sf).select("item_id", tr.keeps_entities(F.col("expansion"), F.array(F.lower(F.substring("query", 1, 4)), F.lit("zzz"))).alias("kept"))


FILL = "[" + ", ".join(f"'{w}'" for w in sorted(tr.FILLER)) + "]"


@query("tr_filler", f"WITH {ROWS}, t AS (SELECT item_id, list_filter({LOW.format('expansion')}, lambda w: list_contains({FILL}, w)) AS f, {LOW.format('query')} AS q FROM r) SELECT item_id, len(list_filter(f, lambda w: NOT list_contains(q, w))) > 0 AS filler FROM t")
def tr_filler(spark, sf):
    return _rows(spark, sf).select("item_id", tr.has_filler(F.col("expansion"), F.col("query")).alias("filler"))


@query("tr_diverse", f"WITH {ROWS}, p AS (SELECT a.item_id, lower(a.query) AS x, lower(b.query) AS y FROM r a JOIN r b ON b.item_id = a.item_id + 1), w AS (SELECT *, {LOW.format('x')} AS i, {LOW.format('y')} AS j FROM p) SELECT item_id, NOT (contains(x, y) OR contains(y, x)) AND len(i) + len(j) - 2 * len(list_intersect(i, j)) >= 3 AS diverse FROM w")
def tr_diverse(spark, sf):
    r = _rows(spark, sf)
    b = r.select((F.col("item_id") - 1).alias("item_id"), F.col("query").alias("other"))
    return r.join(b, "item_id").select("item_id", tr.diverse(F.col("query"), F.col("other")).alias("diverse"))


@query("tr_echo", f"WITH {ROWS} SELECT item_id, contains(lower(query || ' x'), lower(query)) AND length(query || ' x') < length(query) + 10 AS echo FROM r")
def tr_echo(spark, sf):
    return _rows(spark, sf).select("item_id", tr.echoes(F.concat("query", F.lit(" x")), F.col("query")).alias("echo"))


STOPS = ", ".join(f"'{w}'" for w in sorted(tr.STOP))


REPEATED = "(SELECT coalesce(sum((n - 2) * 2), 0)::INT FROM (SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')) AS w) WHERE length(w) > 2 AND w NOT IN (" + STOPS + ") GROUP BY w HAVING count(*) > 2))"


@query("tr_repeat", f"SELECT item_id, {REPEATED.format('text')} AS penalty FROM benchmark")
def tr_repeat(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tr.repetition(F.col("text")).alias("penalty"))


@query("tr_normalize", f"WITH {ROWS}, l AS (SELECT item_id, trim(unnest(string_split(expansion, chr(10)))) AS line, generate_subscripts(string_split(expansion, chr(10)), 1) AS i FROM r) SELECT item_id, string_agg(line, chr(10) ORDER BY CASE left(line, 3) WHEN 'hyd' THEN 0 WHEN 'lex' THEN 1 ELSE 2 END, i) AS text FROM l WHERE regexp_matches(line, '^(lex|vec|hyde):') GROUP BY item_id")
def tr_normalize(spark, sf):
    return _rows(spark, sf).select("item_id", tr.as_text(tr.normalize(tr.parse(F.col("expansion")))).alias("text"))


@query("tr_dedup", "SELECT conv_id AS file, turn AS line, text AS query FROM conversations WHERE true QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) = 1")
def tr_dedup(spark, sf):
    return tr.dedup(table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.col("text").alias("query")))


@query("tr_split", "SELECT item_id, CASE WHEN ('0x' || substr(md5(text), 1, 8))::BIGINT % 10 < 1 THEN 'validation' ELSE 'train' END AS split FROM benchmark")
def tr_split(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tr.split_of(F.col("text")).alias("split"))


@query("tr_format", "SELECT item_id, '/no_think Expand this search query: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Query intent: find' ELSE '' END AS prompt FROM benchmark")
def tr_format(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tr.prompt(F.col("text"), F.when(F.col("item_id") % 2 == 0, " find ")).alias("prompt"))


CATEGORY = """CASE WHEN len(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> '')) <= 2 THEN 'short_keyword' WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}'))) > 0 THEN 'named_entity'
 WHEN regexp_matches(lower(q), 'latest|recent|new|update|changelog|changed|version|release|news|2024|2025') THEN 'temporal' WHEN starts_with(lower(q), 'how ') THEN 'how_to' WHEN starts_with(lower(q), 'what ') THEN 'what_is'
 WHEN regexp_matches(lower(q), 'difference|vs|versus|compare') THEN 'comparison' WHEN regexp_matches(lower(q), 'meeting|notes|journal|ideas|thoughts') THEN 'personal' ELSE 'other' END"""
ASK = "a AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'how ' WHEN 1 THEN 'what ' WHEN 2 THEN 'latest ' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN lower(text) ELSE text END AS q FROM conversations)"


def _ask(spark, sf):
    k = F.col("turn") % 6
    head = F.when(k == 0, "how ").when(k == 1, "what ").when(k == 2, "latest ").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, F.when(F.col("conv_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))).alias("q"))


@query("tr_categorize", f"WITH {ASK} SELECT conv_id, turn, {CATEGORY} AS category FROM a")
def tr_categorize(spark, sf):
    return _ask(spark, sf).select("conv_id", "turn", tr.category(F.col("q")).alias("category"))


@query("tr_analyze", f"WITH {ASK} SELECT {CATEGORY} AS category, count(*) AS n, count(DISTINCT lower(q)) AS distinct_queries, round(avg(length(q)), 6) AS mean_length FROM a GROUP BY 1")
def tr_analyze(spark, sf):
    return _ask(spark, sf).groupBy(tr.category(F.col("q")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("q")).alias("distinct_queries"), F.round(F.avg(F.length("q")), 6).alias("mean_length"))


_in = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
# a word is a name by its look, or if no stop word lies between it and the last word that is
NAMES = f"""b AS (SELECT item_id, trim(regexp_replace(query, '(?i)\\s+/only:lex\\s*$', '')) AS q, item_id % 3 = 0 AS lone, item_id % 4 = 0 AS failed FROM r),
 w0 AS (SELECT item_id, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS l FROM b),
 w1 AS (SELECT item_id, regexp_replace(unnest(l), '^[.,!?:;()\\[\\]"'']+|[.,!?:;()\\[\\]"'']+$', '', 'g') AS w, unnest(range(len(l))) AS i FROM w0),
 w2 AS (SELECT item_id, i, lower(w) AS low, length(w) > 1 AND w = upper(w) AND w <> lower(w) OR regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN {_in(tr.TERM_STOP)} AND (i > 0 OR lower(w) NOT IN {_in(tr.VERBS)})
  OR length(w) > 1 AND regexp_matches(w, '[.+\\-#@]') OR regexp_matches(w, '^\\p{{Lu}}.*\\p{{Lu}}') AS own FROM w1),
 w3 AS (SELECT *, max(i) FILTER (own) OVER o AS last, max(i) FILTER (NOT own AND (low = '' OR low IN {_in(tr.TERM_STOP)})) OVER o AS stop FROM w2 WINDOW o AS (PARTITION BY item_id ORDER BY i)),
 names AS (SELECT item_id, list_sort(list_distinct(list(low))) AS names FROM w3 WHERE last > coalesce(stop, -1) GROUP BY item_id)"""


@query("tr_entities", f"WITH {ROWS}, {NAMES} SELECT item_id, coalesce(array_to_string(names, ' '), '') AS names FROM b LEFT JOIN names USING (item_id)")
def tr_entities(spark, sf):
    asked = _rows(spark, sf).select("item_id", tr.entities(tr.only_mode(F.col("query"))["query"]).alias("names"))
    return asked.select("item_id", F.array_join(F.array_sort("names"), " ").alias("names"))


def _generic_sql(line: str) -> str:
    """Whether little is left of a line without the words of a stock phrase."""
    tests = []
    for phrase in tr.GENERIC:
        rest = f"lower(trim({line}))"
        for word in phrase.split():
            rest = f"trim(regexp_replace({rest}, '{word}', ''))"
        tests.append(f"(contains(lower({line}), '{phrase}') OR starts_with(lower(trim({line})), '{phrase.split()[0]}')) AND length({rest}) < 3")
    return "(" + " OR ".join(tests) + ")"


LINES = "l AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'How to ' WHEN 1 THEN 'learn about it' WHEN 2 THEN 'search for ' || w[1] ELSE array_to_string(w, ' ') END AS line FROM m)"


@query("tr_generic", f"WITH {ROWS}, {LINES} SELECT item_id, {_generic_sql('line')} AS generic FROM l")
def tr_generic(spark, sf):
    k, vec = F.col("item_id") % 4, F.regexp_extract("expansion", "vec: (.*)", 1)
    line = F.when(k == 0, "How to ").when(k == 1, "learn about it").when(k == 2, F.concat(F.lit("search for "), F.split(vec, " ")[0])).otherwise(vec)
    return _rows(spark, sf).select("item_id", tr.generic(line).alias("generic"))


# the rows of these tables have one lex line, one vec line and one hyde line, or fail
SCORE = f"""{ROWS}, {NAMES},
 x AS (SELECT b.*, w[1] || ' guide' AS lex, trim(array_to_string(w, ' ')) AS vec, trim(array_to_string(w, ' ') || ' ' || array_to_string(w, ' ')) AS hyde, coalesce(names, []) AS names FROM b JOIN m USING (item_id) LEFT JOIN names USING (item_id)),
 y AS (SELECT *, {LOW.format('q')} AS qs, {LOW.format('lex')} AS ls, list_filter({LOW.format('q')}, lambda t: NOT list_contains({TERMS}, t)) AS terms, {_generic_sql('lex')} AS generic, {REPEATED.format('hyde')} AS again FROM x),
 z AS (SELECT *, (lower(lex) = lower(q) OR contains(lower(lex), lower(q)) AND length(lex) < length(q) + 10)::INT AS le, (lower(vec) = lower(q) OR contains(lower(vec), lower(q)) AND length(vec) < length(q) + 10)::INT AS ve,
  len(terms) = 0 OR list_has_any(terms, ls) AS kept, len(list_filter(ls, lambda t: list_contains({FILL}, t) AND NOT list_contains(qs, t))) > 0 AS filler, len(list_filter(names, lambda e: contains(lower(lex), e))) > 0 AS ln,
  len(list_filter(names, lambda e: contains(lower(vec), e))) > 0 AS vn, len(list_filter(names, lambda e: NOT contains(lower(lex || ' ' || vec), e))) AS lost, contains(vec, ' ') AND length(vec) > 15 AS sentence FROM y),
 d AS (SELECT item_id, lone, failed, le, CASE WHEN failed THEN 0 WHEN lone THEN 10 ELSE 30 END AS format,
  CASE WHEN failed THEN 0 WHEN lone THEN 15 - 5 * le ELSE 25 + greatest(-10, 5 - 10 * le - 3 * ve) END AS diversity,
  CASE WHEN failed OR lone THEN 0 ELSE 10 + CASE WHEN length(hyde) BETWEEN 50 AND 200 THEN 5 WHEN length(hyde) < 50 THEN 2 ELSE 0 END + greatest(0, 5 - again) END AS hyde,
  CASE WHEN failed THEN 0 WHEN lone THEN 10 + 5 * kept::INT + 5 * (NOT generic)::INT - 10 * filler::INT
   ELSE 5 + 5 * (length(lex) <= length(vec))::INT + CASE WHEN sentence THEN 5 ELSE 2 END + 5 * kept::INT - 10 * filler::INT + 5 * (len(qs) > 1 AND contains(lex, '"'))::INT + 5 * regexp_matches(lex, '\\s-[\\p{{L}}\\p{{N}}_]')::INT END AS quality,
  CASE WHEN failed THEN 0 WHEN lone THEN CASE WHEN len(names) = 0 THEN 10 WHEN ln THEN 20 ELSE -55 END WHEN len(names) = 0 THEN 10
   ELSE CASE WHEN ln THEN 15 ELSE -65 END - 65 * lost - 15 * generic::INT + 5 * vn::INT END AS entity, CASE WHEN failed THEN 0 ELSE 20 END AS think,
  CASE WHEN failed THEN 100 WHEN lone THEN 120 ELSE 140 END AS most FROM z),
 t AS (SELECT *, format + diversity + hyde + quality + entity + think AS total FROM d),
 s AS (SELECT *, least(CASE WHEN NOT lone AND NOT failed AND le = 1 THEN 50 ELSE 100 END, greatest(0, 100 * total::DOUBLE / most)) AS share FROM t),
 scores AS (SELECT item_id, format::INT AS format, diversity::INT AS diversity, hyde::INT AS hyde, quality::INT AS quality, CASE WHEN lone THEN entity ELSE greatest(0, entity) END::INT AS entity, think::INT AS think, CASE WHEN lone THEN total ELSE greatest(0, total) END::INT AS total, most::INT AS most, round(share, 1) AS percentage,
  CASE WHEN share >= 80 THEN 'Excellent' WHEN share >= 60 THEN 'Good' WHEN share >= 40 THEN 'Acceptable' WHEN share >= 20 THEN 'Poor' ELSE 'Failed' END AS rating FROM s)"""


@query("tr_score", f"WITH {SCORE} SELECT * FROM scores")
def tr_score(spark, sf):
    return tr.scored(_rows(spark, sf), ["item_id"])


@query("tr_score_file", f"WITH {SCORE} SELECT item_id % 4 AS file, round(avg(percentage), 4) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY percentage) AS median, min(percentage) AS least, max(percentage) AS most, round(avg((percentage >= 70)::INT), 4) AS good FROM scores GROUP BY 1")
def tr_score_file(spark, sf):
    s = tr.scored(_rows(spark, sf).withColumn("file", F.col("item_id") % 4), ["file"])
    return s.groupBy("file").agg(F.round(F.avg("percentage"), 4).alias("mean"), F.expr("percentile_disc(0.5) within group (order by percentage)").alias("median"), F.min("percentage").alias("least"), F.max("percentage").alias("most"), F.round(F.avg((F.col("percentage") >= 70).cast("double")), 4).alias("good"))
