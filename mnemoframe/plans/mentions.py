"""Queries of names in texts with their oracle SQL. The entities are words of the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import mentions
from mnemoframe.plans.catalog import query
from mnemoframe.sources.tables import memories, read

ENTITIES = """w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS word FROM benchmark), entities AS MATERIALIZED (SELECT lower(word) AS name, count(*) AS mentions, lower(word) LIKE 's%' AS invalid FROM w GROUP BY 1, 3)"""
NO_NAMES = ", ".join(f"'{w}'" for w in mentions.NO_NAMES)


def entities(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), F.lit(1))).alias("word"))
    return words.groupBy(F.lower("word").alias("name")).agg(F.count("*").alias("mentions")).withColumn("invalid", F.col("name").startswith("s"))


# a name of letters stands in a text with borders just if it is one of its longest runs of letters
G1 = f"""WITH {ENTITIES},
 runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z一-鿿]+')) AS name FROM documents),
 top AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, name) AS place FROM runs JOIN entities USING (name) WHERE NOT invalid QUALIFY place <= 5),
 pieces AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS ws FROM documents)),
 caps AS (SELECT doc_id, lower(word) AS low, min(word) AS word, min(pos) AS pos FROM pieces WHERE regexp_full_match(word, '[A-Z][a-z]{{2,}}') AND word NOT IN ({NO_NAMES}) GROUP BY 1, 2),
 fresh AS (SELECT doc_id, low, word, pos FROM caps WHERE (doc_id, low) NOT IN (SELECT (doc_id, name) FROM top))
 SELECT doc_id, place, name, true AS known FROM top UNION ALL
 SELECT doc_id, 5 + row_number() OVER (PARTITION BY doc_id ORDER BY pos), coalesce(name, word), name IS NOT NULL FROM fresh LEFT JOIN entities ON name = low"""


@query("g1_mentions", G1)
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return mentions.mentioned(docs, entities(spark, d)).withColumnRenamed("id", "doc_id")


@query("g1_activation", f"""WITH {ENTITIES}, e AS (SELECT name, CASE WHEN mentions % 3 = 0 THEN 0.2e0 ELSE 0 END AS activation, invalid FROM entities), said AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z一-鿿]+')) AS name FROM conversations) JOIN entities USING (name) WHERE NOT invalid GROUP BY name),
 o AS (SELECT name, lead(name) OVER (ORDER BY name) AS next FROM entities), edges AS (SELECT name AS source, next AS target FROM o WHERE next IS NOT NULL AND name NOT LIKE 'h%'), ends AS (SELECT source AS name, target AS there FROM edges UNION ALL SELECT target, source FROM edges),
 near AS (SELECT there AS name, sum(n) AS m FROM ends JOIN said USING (name) GROUP BY there) SELECT e.name, round(least(1, activation + 0.3e0 * coalesce(n, 0) + CASE WHEN invalid THEN 0 ELSE 0.1e0 * coalesce(m, 0) END), 6) AS activation FROM e LEFT JOIN said USING (name) LEFT JOIN near USING (name)""")
def _(spark, d):
    e = entities(spark, d).withColumn("activation", F.expr("if(mentions % 3 = 0, 0.2D, 0.0D)"))
    turns = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    said = mentions.occurrences(turns, e.where("not invalid").select("name"), borders=True, any_case=True).select("name")
    edges = e.select(F.col("name").alias("source"), F.expr("lead(name) over (order by name)").alias("target")).where("target is not null").withColumn("invalid", F.col("source").startswith("h"))
    return mentions.activated(e, said, edges).withColumn("activation", F.round("activation", 6))


@query("j2_memory_index", f"WITH {ENTITIES} SELECT name, count(*) AS n, min(doc_id) AS first, sum(doc_id) AS total FROM documents JOIN entities ON contains(text, name) WHERE doc_id % 8 <> 7 AND NOT invalid GROUP BY name")
def _(spark, d):
    index = mentions.memory_index(memories(spark, d), entities(spark, d))
    return index.groupBy("name").agg(F.count("*").alias("n"), F.min("memory_id").alias("first"), F.sum("memory_id").alias("total"))


_WORD = r"[一-鿿]{2,4}|[a-zA-Z]{2,}|\d+"
# what suppliers and customers are, asked for by nation and segment
J10 = rf"""WITH facts AS MATERIALIZED (SELECT 10 * c_custkey AS fact_id, lower(c_name) AS subject, 'market segment' AS predicate, lower(c_mktsegment) AS object, 0.5e0 + (c_custkey % 5) / 10.0e0 AS confidence FROM customer
  UNION ALL SELECT 10 * c_custkey + 1, lower(c_name), 'nation', lower(n_name), 0.7e0 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 10 * s_suppkey + 2, lower(s_name), 'nation of supplier', lower(n_name), 0.7e0 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 q AS (SELECT DISTINCT n_nationkey AS query_id, unnest(regexp_extract_all(lower('Which supplier or customer of ' || n_name || ' is in furnitures, ' || n_regionkey), '{_WORD}')) AS word FROM nation),
 fw AS (SELECT fact_id, word, count(*) AS k FROM (SELECT fact_id, unnest(regexp_extract_all(subject || ' ' || predicate || ' ' || object, '{_WORD}')) AS word FROM facts) GROUP BY 1, 2),
 s AS (SELECT query_id, f.fact_id, predicate, confidence * sum(CASE WHEN contains(object, word) OR contains(word, object) THEN 2e0 ELSE 0 END + CASE WHEN contains(predicate, word) THEN 1.5e0 ELSE 0 END + CASE WHEN contains(subject, word) THEN 0.5e0 ELSE 0 END + coalesce(fw.k, 0)) AS score
  FROM facts f CROSS JOIN q LEFT JOIN fw USING (fact_id, word) GROUP BY query_id, f.fact_id, predicate, confidence)
 SELECT query_id, fact_id, predicate, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, predicate ORDER BY score DESC, fact_id) <= 2"""


@query("j10_fact_matches", J10)
def _(spark, d):
    c, n, s = (read(spark, d, t) for t in ("customer", "nation", "supplier"))
    one = c.selectExpr("10 * c_custkey as fact_id", "c_name as subject", "'market segment' as predicate", "c_mktsegment as object", "0.5D + (c_custkey % 5) / 10.0D as confidence")
    two = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("10 * c_custkey + 1", "c_name", "'nation'", "n_name", "0.7D")
    three = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("10 * s_suppkey + 2", "s_name", "'nation of supplier'", "n_name", "cast(null as double)")
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.explode(F.regexp_extract_all(F.lower(F.concat(F.lit("Which supplier or customer of "), "n_name", F.lit(" is in furnitures, "), "n_regionkey")), F.lit(f"({_WORD})"), F.lit(1))).alias("word")).distinct()
    return mentions.fact_matches(asked, one.unionAll(two).unionAll(three)).withColumn("score", F.round("score", 6))
