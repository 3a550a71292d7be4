"""Queries of sinks: snippets of documents as rows of each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import status
from gleanery.plans.catalog import DOCS, docs, query
from gleanery.plans.fusion import SNIP, snippets
from gleanery.sources import sinks as out

BASE = f"WITH {DOCS}, {SNIP}, res AS (SELECT doc_id, substr(hash, 1, 6) AS docid, round((doc_id % 100) / 100.0::DOUBLE, 2) AS score, path AS file, 'doc_' || doc_id AS title, lang AS context, line, snippet, body FROM docs JOIN done USING (doc_id))"
QUOTE = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _results(spark, sf):
    d = docs(spark, sf).select("doc_id", F.substring("hash", 1, 6).alias("docid"), F.round((F.col("doc_id") % 100) / 100.0, 2).alias("score"), F.col("path").alias("file"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("context"), "body")
    return d.join(snippets(spark, sf).select("doc_id", "line", "snippet"), "doc_id")


C = F.col


@query("sink_json", f"{BASE} SELECT doc_id, '#' || docid AS docid, round(score, 2) AS score, file, title, left(snippet, 300) AS snippet FROM res")
def sink_json(spark, sf):
    made = _results(spark, sf).select("doc_id", out.row_json(C("docid"), C("score"), C("file"), C("title"), F.substring("snippet", 1, 300)).alias("j"))
    return made.select("doc_id", F.from_json("j", "docid string, score double, file string, title string, snippet string").alias("r")).select("doc_id", "r.*")


@query("sink_csv", f"{BASE} SELECT doc_id, '#' || docid || ',' || printf('%.4f', round(score, 4)) || ',' || file || ',' || title || ',' || context || ',' || line || ',' || {QUOTE.format('snippet')} AS line FROM res")
def sink_csv(spark, sf):
    return _results(spark, sf).select("doc_id", out.row_csv(C("docid"), C("score"), C("file"), C("title"), C("context"), C("line"), C("snippet")).alias("line"))


@query("sink_files", f"{BASE} SELECT doc_id, '#' || docid || ',' || printf('%.2f', round(score, 2)) || ',' || file || ',' || context AS line FROM res")
def sink_files(spark, sf):
    return _results(spark, sf).select("doc_id", out.row_files(C("docid"), C("score"), C("file"), C("context")).alias("line"))


@query("sink_md", f"{BASE} SELECT doc_id, '---' || chr(10) || '# ' || title || chr(10) || chr(10) || '**docid:** `#' || docid || '`' || chr(10) || '**context:** ' || context || chr(10) || chr(10) || snippet || chr(10) AS text, '````' AS fence FROM res")
def sink_md(spark, sf):
    return _results(spark, sf).select("doc_id", out.row_markdown(C("docid"), C("file"), C("title"), C("context"), C("snippet")).alias("text"), out.fence(F.concat("snippet", F.lit("```"))).alias("fence"))


@query("sink_xml", f"{BASE} SELECT doc_id, '<file docid=\"#' || docid || '\" name=\"' || file || '\" title=\"' || title || '\">' || chr(10) || {XML.format('snippet')} || chr(10) || '</file>' AS text FROM res")
def sink_xml(spark, sf):
    return _results(spark, sf).select("doc_id", out.row_xml(C("docid"), C("file"), C("title"), C("snippet")).alias("text"))


@query("sink_mcp_csv", f"{BASE} SELECT doc_id, '#' || docid || ',' || file || ',' || title || ',' || printf('%.6f', score) || ',' || context || ',' || {QUOTE.format('snippet')} AS line FROM res")
def sink_mcp_csv(spark, sf):
    return _results(spark, sf).select("doc_id", F.concat_ws(",", F.concat(F.lit("#"), "docid"), out.csv_field(C("file")), out.csv_field(C("title")), out.fixed(C("score"), 6), out.csv_field(C("context")), out.csv_field(C("snippet"))).alias("line"))


@query("sink_documents", f"{BASE} SELECT doc_id, file || ',' || title || ',' || {QUOTE.format('body')} AS line FROM res WHERE length(body) <= 10240")
def sink_documents(spark, sf):
    return _results(spark, sf).where(F.length("body") <= 10240).select("doc_id", F.concat_ws(",", "file", "title", out.csv_field(C("body"))).alias("line"))


@query("sink_document", f"{BASE} SELECT doc_id, '<document path=\"' || file || '\">' || chr(10) || {XML.format('body')} || chr(10) || '</document>' AS text FROM res")
def sink_document(spark, sf):
    return _results(spark, sf).select("doc_id", F.concat(F.lit('<document path="'), "file", F.lit('">\n'), out.xml_escape(C("body")), F.lit("\n</document>")).alias("text"))


@query("capability_manifest", f"""WITH {DOCS} SELECT collection, '{{"documents":' || count(*) || ',"active":' || count(*) FILTER (active) || ',"last_modified":"' || max(modified_at) || '"}}' AS manifest FROM docs GROUP BY collection""")
def capability_manifest(spark, sf):
    return status.manifest(docs(spark, sf))
