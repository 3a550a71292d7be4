"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled page outcomes are counted by host and summed to registered domains and suffixes.  At each
level the rate of bad pages is a beta-binomial posterior whose prior is the posterior mean of the
level above; how strongly it pulls is estimated from the spread between the groups of that level.  A
host is blocked when the lower bound of its posterior rate is above the limit.

DataFrame functions only.  Page rows are reduced to host counts before any shuffle by host, and these are
written once; what goes to the driver is a row of totals for each level.  Null urls and urls without :// have empty host and path; unknown
outcomes count for nothing; hosts without outcomes get their domain's posterior.  Repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Suffixes of two labels under which names are registered: the commonest; suffixes_of() reads all from a file of the public list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
LIMIT, Z = 0.3, 1.6448536269514722


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    there = F.instr(url, "://") > 0
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def rule_for(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits, as text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))) & F.startswith(F.col(path), F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffixes_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The suffixes of two labels of a file in the form of the public suffix list (a rule a line, // begins a comment), for `judge` and `reputation`.

    Wildcards and exceptions name no suffix of two labels themselves and are passed over. The list has some ten thousand lines.
    """
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rows = spark.read.text(path).select(rule.alias("rule")).where(~F.startswith("rule", F.lit("//")) & F.col("rule").rlike(r"^[^.*!]+\.[^.*!]+$"))
    return tuple(sorted(r["rule"] for r in rows.distinct().collect()))


def _moments(level: str) -> list[Column]:
    return [F.count("*").alias(f"{level}_k"), F.sum(F.col("n") * F.col("n")).alias(f"{level}_nn"), F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))).alias(f"{level}_xx")]


def strength(k: float, total: float, bad: float, nn: float, xx: float) -> float:
    """Prior weight by the method of moments, from sums over groups: of n squared and of bad squared over n."""
    if not total or k < 2 or bad in (0, total):
        return 20.0
    p = bad / total
    spread = (xx - p * bad) / (p * (1 - p))
    free = total - nn / total - (k - 1)
    rho = (spread - (k - 1)) / free if free > 0 else 0.0
    return 1 / min(max(rho, 0.002), 0.5) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, z: float = Z, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host and blocked, for every host of pages (page_id, host); outcomes: page_id, bad (0 or 1)."""
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    joined = pages.select("page_id", "host").join(known, "page_id", "left")
    hosts = joined.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    two = F.array_join(F.slice(F.split("host", r"\."), F.lit(-2), F.lit(2)), ".")
    last = lambda n: F.when(F.size(F.split("host", r"\.")) <= n, F.col("host")).otherwise(F.array_join(F.slice(F.split("host", r"\."), F.lit(-n), F.lit(n)), "."))
    long_suffix = F.when(F.size(F.split("host", r"\.")) > 2, two.isin(*two_labels)).otherwise(F.lit(False))
    hosts = hosts.withColumn("domain", F.when(long_suffix, last(3)).otherwise(last(2))).withColumn("suffix", F.when(long_suffix, last(2)).otherwise(last(1)))
    hosts = written(pages.sparkSession, hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = lambda df, level: df.where("n > 0").agg(*_moments(level), F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    h, d, s = seen(hosts, "h"), seen(domains, "d"), seen(suffixes, "s")
    total, bad = h["n"] or 0.0, h["bad"] or 0.0
    rate = (bad + 0.5) / (total + 1)
    pull = {x: strength(r[f"{x}_k"], total, bad, r[f"{x}_nn"] or 0.0, r[f"{x}_xx"] or 0.0) for x, r in (("h", h), ("d", d), ("s", s))}
    mean = lambda level, prior: (F.col("bad") + pull[level] * prior) / (F.col("n") + pull[level])
    suffixes = suffixes.select("suffix", mean("s", F.lit(rate)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", mean("d", F.col("suffix_mean")).alias("domain_mean"))
    m = mean("h", F.col("domain_mean"))
    low = m - z * F.sqrt(m * (1 - m) / (F.col("n") + pull["h"] + 1))
    return hosts.join(domains, ["suffix", "domain"]).select("host", (low > limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_for("host", "path", rules))
    said = F.create_map(*[F.lit(x) for r in rules for x in r])
    verdict = F.when(F.col("rule").isNotNull(), said[F.col("rule")]).when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(reputation(parsed, outcomes, limit, z, two_labels), "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its id says toxic or low quality: in the test tables, labels of documents stand in for outcomes of pages."""
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; null urls have empty host and path and get the verdict of the empty host."""
    return judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def _op7_sql() -> str:
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)
    said = " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in longest)
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    pull = """CASE WHEN g.n IS NULL OR g.n = 0 OR {t}.k < 2 OR g.bad IN (0, g.n) THEN 20.0::DOUBLE ELSE 1 / least(greatest(CASE WHEN {t}.free > 0
      THEN (({t}.xx - g.p * g.bad) / (g.p * (1 - g.p)) - ({t}.k - 1)) / {t}.free ELSE 0 END, 0.002::DOUBLE), 0.5::DOUBLE) - 1 END"""
    level = "SELECT count(*)::DOUBLE k, sum(bad * bad / n) xx, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) free FROM {} WHERE n > 0"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
known AS (SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts0 AS (SELECT host, count(known.bad)::DOUBLE AS n, coalesce(sum(known.bad), 0)::DOUBLE AS bad FROM parsed LEFT JOIN known USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS l FROM hosts0),
flagged AS (SELECT *, len(l) > 2 AND array_to_string(l[-2:], '.') IN ({two}) AS long FROM parts),
hosts AS (SELECT host, n, bad, CASE WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
  CASE WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM flagged),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
g AS (SELECT sum(n) AS n, sum(bad) AS bad, sum(bad) / nullif(sum(n), 0) AS p, (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS rate FROM hosts),
hl AS ({level.format("hosts")}), dl AS ({level.format("domains")}), sl AS ({level.format("suffixes")}),
w AS (SELECT g.rate, {pull.format(t="hl")} AS h, {pull.format(t="dl")} AS d, {pull.format(t="sl")} AS s FROM g, hl, dl, sl),
sm AS (SELECT suffix, (bad + w.s * w.rate) / (n + w.s) AS m FROM suffixes, w),
dm AS (SELECT suffix, domain, (domains.bad + w.d * sm.m) / (domains.n + w.d) AS m FROM domains JOIN sm USING (suffix), w),
hm AS (SELECT host, n, w.h AS pull, (hosts.bad + w.h * dm.m) / (hosts.n + w.h) AS m FROM hosts JOIN dm USING (suffix, domain), w),
rep AS (SELECT host, m - {Z}::DOUBLE * sqrt(m * (1 - m) / (n + pull + 1)) > {LIMIT}::DOUBLE AS blocked FROM hm)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM parsed LEFT JOIN rep USING (host)"""


OP7_SQL = _op7_sql()
