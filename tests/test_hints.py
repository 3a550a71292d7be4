import random
import re
import time

from pyspark.sql import functions as F

from gleanery.operators import fusion

BONUS = {"god_node": 0.2, "surprising_edge": 0.15}


def brute(queries, hints, limit):
    out = []
    for qid in {q[0] for q in queries}:
        rows = []
        for _, graph, text in (q for q in queries if q[0] == qid):
            words = [t for t in re.split(r"[^a-z0-9_]+", (text or "").lower()) if len(t) > 2]
            for hid, g, kind, title, body in hints if words else ():
                hay = " ".join(x for x in (title, body) if x is not None).lower()
                score = sum(t in hay for t in words) + BONUS.get(kind, 0.0)
                if g == graph and score > 0:
                    rows.append((-score, hid, kind))
        out += [(qid, hid, kind, -score, i + 1) for i, (score, hid, kind) in enumerate(sorted(rows, key=lambda r: r[:2])[:limit])]
    return sorted(out)


def test_hints_equal_brute_force(spark):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("ab_1é") for _ in range(pick.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(pick.randrange(n))).upper()
    kinds = ["god_node", "surprising_edge", "other", None]
    hints = [(i, pick.randrange(4), pick.choice(kinds), pick.choice(["en", "abab", None]), pick.choice([text(12), text(3), None])) for i in range(150)] + [(150, 9, "other", "en", "ab" * 9000), (151, 8, "other", "t", "abc")]
    queries = [(i, pick.randrange(5), text(9)) for i in range(60)]
    # a word no hint holds, a word twice, nothing to ask for, no text, a graph with long runs, one without bonus or hit
    queries += [(60, 1, "nosuchword"), (61, 1, "aab aab"), (62, 1, "ab"), (63, 1, None), (64, 9, "bababa abababababab"), (65, 8, "nosuchword"), (66, 2, "b1a nosuchword")]
    q = spark.createDataFrame(queries, "query_id bigint, graph bigint, text string")
    h = spark.createDataFrame(hints, "hint_id bigint, graph bigint, kind string, title string, body string")
    got = sorted(map(tuple, fusion.arch_hints(q, h, 5, ["graph"]).collect()))
    assert got == brute(queries, hints, 5) and {r[0] for r in got} >= {60, 61, 64, 66}
    assert fusion.arch_hints(q.limit(0), h, 5, ["graph"]).count() == fusion.arch_hints(q, h.limit(0), 5, ["graph"]).count() == 0


def test_copies_of_a_hint_are_rows_of_their_own(spark):
    h = spark.createDataFrame([(1, 0, "god_node", "t", "alpha"), (1, 0, "god_node", "t", "alpha"), (1, 0, "god_node", "t", "none"), (2, 0, "other", "t", "alpha")], "hint_id bigint, graph bigint, kind string, title string, body string")
    q = spark.createDataFrame([(7, 0, "alpha")], "query_id bigint, graph bigint, text string")
    assert [(r[1], r[3]) for r in sorted(map(tuple, fusion.arch_hints(q, h, 5, ["graph"]).collect()), key=lambda r: r[4])] == [(1, 1.2), (1, 1.2), (2, 1.0), (1, 0.2)]


def test_texts_are_cut_once_and_not_for_each_word(spark):
    # 400 texts of 40 kB against 100 queries of 60 words: 96 GB if each word lower-cased and read each text
    h = spark.range(400, numPartitions=4).select(F.col("id").alias("hint_id"), F.lit(0).alias("graph"), F.lit("other").alias("kind"), F.lit("é").alias("title"), F.repeat(F.concat(F.lit("Énd "), F.col("id").cast("string"), F.lit(" word ")), 3000).alias("body"))
    q = spark.range(100).select(F.col("id").alias("query_id"), F.lit(0).alias("graph"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * 100 + F.col("id")).cast("string"), F.lit("x"))), " ").alias("text"))
    began = time.time()
    assert fusion.arch_hints(q.withColumn("text", F.concat("text", F.lit(" word"))), h, 5, ["graph"]).count() == 500
    assert time.time() - began < 60
