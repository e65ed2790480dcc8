"""Queries of signatures and topic clusters with their oracle SQL, over documents as memories of four users."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.operators import clusters
from mnemoframe.plans.catalog import query
from mnemoframe.sources.tables import read

TURNS = "turns AS MATERIALIZED (SELECT doc_id % 4 AS user_id, doc_id AS id, text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id DESC) <= 200)"
WEIGHTS = """t AS (SELECT user_id, id, lower(unnest(regexp_extract_all(text, '[一-鿿]{2,}|[a-zA-Z]{3,}'))) AS term FROM turns), tf AS (SELECT user_id, id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT user_id, term, count(*) AS df FROM tf GROUP BY ALL),
 n AS (SELECT user_id, count(*) AS n FROM turns GROUP BY user_id), idf AS MATERIALIZED (SELECT user_id, term, ln(n / (1 + df)) AS idf FROM df JOIN n USING (user_id)), vec AS MATERIALIZED (SELECT tf.user_id, id, term, tf * idf AS weight FROM tf JOIN idf USING (user_id, term))"""
TOKENS = """placed AS (SELECT user_id, id, word, min(pos) AS pos FROM (SELECT user_id, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT user_id, id, list_transform(regexp_extract_all(text, '[a-zA-Z]{2,}|[0-9]+'), lambda x: lower(x)) AS ws FROM turns)) GROUP BY ALL),
 token AS MATERIALIZED (SELECT user_id, id, word AS term FROM placed UNION ALL SELECT user_id, id, word || '_' || next FROM (SELECT *, lead(word) OVER (PARTITION BY id ORDER BY pos) AS next FROM placed) WHERE next IS NOT NULL)"""
SIGNED = f"""{TURNS}, {WEIGHTS}, {TOKENS}, h AS MATERIALIZED (SELECT term, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(term) + 1), lambda i: unicode(term[i])::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM (SELECT DISTINCT term FROM token)),
 v AS (SELECT user_id, id, k, sum(CASE WHEN (h >> k::UBIGINT) & 1 = 1 THEN w ELSE -w END) AS v FROM (SELECT token.user_id, id, h, coalesce(CAST(round(idf * 1000000) AS BIGINT), 10000) AS w FROM token JOIN h USING (term) LEFT JOIN idf ON idf.user_id = token.user_id AND idf.term = token.term), range(64) r(k) GROUP BY ALL),
 m AS (SELECT user_id, id, list_sort(list(v))[33] AS middle FROM v GROUP BY ALL),
 signed AS MATERIALIZED (SELECT turns.user_id, turns.id, coalesce(s, 0)::UBIGINT AS s FROM turns LEFT JOIN (SELECT id, bit_or(CASE WHEN v > middle THEN 1::UBIGINT << k::UBIGINT ELSE 0::UBIGINT END) AS s FROM v JOIN m USING (user_id, id) GROUP BY id) x USING (id))"""
PAIRS = f"""{SIGNED}, norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY id), dots AS MATERIALIZED (SELECT a.user_id, a.id AS a, b.id AS b, sum(a.weight * b.weight) AS dot FROM vec a JOIN vec b ON a.user_id = b.user_id AND a.term = b.term AND a.id < b.id GROUP BY ALL),
 alike AS MATERIALIZED (SELECT user_id, a, b, dot / (x.norm * y.norm) AS cosine FROM dots JOIN norms x ON x.id = a JOIN norms y ON y.id = b WHERE x.norm * y.norm > 0 AND dot / (x.norm * y.norm) >= 0.25),
 pairs AS MATERIALIZED (SELECT alike.user_id, a, b, bit_count(xor(x.s, y.s)) / 64 AS apart, cosine FROM alike JOIN signed x ON x.id = a JOIN signed y ON y.id = b WHERE bit_count(xor(x.s >> 56::UBIGINT, y.s >> 56::UBIGINT)) <= 1 AND bit_count(xor(x.s, y.s)) <= 25)"""


def turns(spark, d):
    return clusters.newest_of(read(spark, d, "documents").select((F.col("doc_id") % 4).alias("user_id"), F.col("doc_id").alias("id"), "text"))


@query("t1_bigram_tokens", f"WITH {TURNS}, {TOKENS} SELECT id, count(term) AS n, count(DISTINCT term) AS kinds, min(term) AS first, max(term) AS last FROM token GROUP BY id")
def _(spark, d):
    t = turns(spark, d).select("id", F.explode(T.bigram_tokens(F.col("text"))).alias("term"))
    return t.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("kinds"), F.min("term").alias("first"), F.max("term").alias("last"))


@query("t9_signatures", f"WITH {SIGNED} SELECT id, lower(printf('%016x', s)) AS signature FROM signed")
def _(spark, d):
    t = turns(spark, d)
    signed = clusters.signatures(t, clusters.vectors(t))
    return signed.select("id", F.lower(F.lpad(F.hex("signature"), 16, "0")).alias("signature"))


@query("t10_cosine", f"WITH {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM alike")
def _(spark, d):
    return clusters.cosine_pairs(clusters.vectors(turns(spark, d))).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("j5_similar_pairs", f"WITH {PAIRS} SELECT a, b, apart, round(cosine, 6) AS cosine FROM pairs")
def _(spark, d):
    return clusters.similar_pairs(turns(spark, d)).select("a", "b", "apart", F.round("cosine", 6).alias("cosine"))


@query("j5_topic_clusters", f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u), c AS (SELECT v AS id, min(u) AS cluster FROM r GROUP BY v)
 SELECT id, cluster FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY cluster HAVING count(*) >= 3)""")
def _(spark, d):
    return clusters.topic_clusters(turns(spark, d))


@query("j5_recall", f"WITH {PAIRS} SELECT (SELECT count(*) FROM alike) AS alike, (SELECT count(*) FROM pairs) AS found")
def _(spark, d):
    t = turns(spark, d)
    return clusters.cosine_pairs(clusters.vectors(t)).agg(F.count("*").alias("alike")).crossJoin(clusters.similar_pairs(t).agg(F.count("*").alias("found")))  # one row each
