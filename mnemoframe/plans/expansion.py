"""Queries of query expansion with their oracle SQL. The queries are the first words of the benchmark passages; synonyms and concepts
are words of the conversations with the same beginning or end, as no table holds any."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import expansion, graph, stats
from mnemoframe.operators.field import STOP_WORDS
from mnemoframe.plans.catalog import query
from mnemoframe.plans.insight import _PAIRS
from mnemoframe.sources.shared import stored
from mnemoframe.sources.tables import memories, read

_ORD = "CAST('0x' || substring(md5({0}), 1, 7) AS BIGINT)"
TABLES = f"""{_PAIRS}, vocabulary AS MATERIALIZED (SELECT term AS word FROM df WHERE regexp_full_match(term, '[a-z]{{5,}}') AND df BETWEEN 2 AND 6),
 synonyms AS MATERIALIZED (SELECT key, word AS synonym, {_ORD.format('word')} AS ord FROM vocabulary JOIN (SELECT min(word) AS key, left(word, 4) AS p FROM vocabulary GROUP BY 2) ON p = left(word, 4) WHERE word <> key),
 concepts AS MATERIALIZED (SELECT parent, word AS child FROM vocabulary JOIN (SELECT max(word) AS parent, right(word, 3) AS p FROM vocabulary GROUP BY 2) ON p = right(word, 3) WHERE word <> parent),
 e0 AS (SELECT w1 AS a, w2 AS b FROM pmi WHERE n >= 2 AND pmi >= 3 AND w1 > 'q' AND w2 > 'q'), b0 AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r0 AS (SELECT a AS v, a AS u FROM b0 UNION SELECT r0.v, b0.b FROM r0 JOIN b0 ON b0.a = r0.u), k0 AS (SELECT v AS word, min(u) AS cluster FROM r0 GROUP BY v),
 clusters AS MATERIALIZED (SELECT word, cluster FROM k0 WHERE cluster IN (SELECT cluster FROM k0 GROUP BY cluster HAVING count(*) BETWEEN 2 AND 20)),
 asked AS MATERIALIZED (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM (SELECT item_id AS query_id, word, min(pos) AS pos FROM (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[a-zA-Z]{{4,}}'), lambda x: lower(x)) AS ws FROM benchmark)) GROUP BY ALL) QUALIFY place <= 6)"""
_PART = " AND w1 > 'q' AND w2 > 'q'"  # a cut of the clusters, which the queries that read no clusters keep in their SQL
_NEAR = """both_ways AS (SELECT w1 AS word, w2 AS other, pmi FROM pmi WHERE pmi > {least} UNION ALL SELECT w2, w1, pmi FROM pmi WHERE pmi > {least}), near AS (SELECT query_id, place, other, pmi, row_number() OVER (PARTITION BY query_id, place ORDER BY pmi DESC, other) AS rank FROM asked JOIN both_ways USING (word) WHERE (query_id, other) NOT IN (SELECT (query_id, word) FROM asked) AND other IN (SELECT term FROM df WHERE df >= {df})),
 taken AS (SELECT query_id, unnest(list_reduce(list_transform(list({{'place': place, 'rank': rank, 'other': other, 'pmi': pmi}} ORDER BY place, rank), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.place = x[1].place)) >= 3 OR list_contains(list_transform(acc, lambda t: t.other), x[1].other) THEN acc ELSE list_concat(acc, x) END)) AS t FROM near WHERE rank <= 40 GROUP BY query_id)"""
# a word's forms in the order in which a table is asked for them
_FORMS = lambda stems: "[word, " + ", ".join(f"regexp_replace(word, '{p.removeprefix('(?i)')}', '{by}')" for p, by in stems) + "]"
EXPANSION = f"""{TABLES.replace(_PART, '')}, {_NEAR.format(least='(SELECT CASE WHEN total < 100 THEN 0.7 ELSE 1 END FROM total)', df='(SELECT CASE WHEN total < 100 THEN 1 ELSE 2 END FROM total)')},
 firsts AS (SELECT key, min(ord) AS first FROM synonyms GROUP BY key), forms AS MATERIALIZED (SELECT query_id, word, place, unnest({_FORMS(expansion.CHILD_STEMS)}) AS form, unnest(range({len(expansion.CHILD_STEMS) + 1})) AS k FROM asked),
 downs AS (SELECT query_id, word, place, arg_min(form, k) AS parent FROM forms WHERE (k = 0 OR form <> word) AND form IN (SELECT parent FROM concepts) GROUP BY ALL),
 upforms AS MATERIALIZED (SELECT query_id, word, place, unnest({_FORMS(expansion.PARENT_STEMS)}) AS form, unnest(range({len(expansion.PARENT_STEMS) + 1})) AS k FROM asked), ups AS (SELECT query_id, word, place, arg_min(form, k) AS child FROM upforms WHERE (k = 0 OR form <> word) AND form IN (SELECT child FROM concepts) GROUP BY ALL),
 parts AS (SELECT query_id, t.other AS word, least(0.8, t.pmi / 5) AS weight, [0, t.place, 0, 0, 0, t.rank] AS pos FROM taken UNION ALL SELECT query_id, synonym, 0.9, [1, place, 0, 0, 0, ord] FROM asked JOIN synonyms ON word = key
  UNION ALL SELECT query_id, s.key, 0.9, [1, place, 1, first, 0, 0] FROM asked JOIN synonyms s ON word = s.synonym JOIN firsts f ON f.key = s.key UNION ALL SELECT query_id, p.synonym, 0.7, [1, place, 1, first, 1, p.ord] FROM asked JOIN synonyms s ON word = s.synonym JOIN firsts f ON f.key = s.key JOIN synonyms p ON p.key = s.key WHERE p.synonym <> word
  UNION ALL SELECT query_id, y.word, 0.85, [2, place, 0, 0, 0, 0] FROM asked JOIN clusters x ON x.word = asked.word JOIN clusters y ON y.cluster = x.cluster WHERE y.word <> x.word AND length(y.word) >= 2 UNION ALL SELECT query_id, child, 0.85, [3, place, 0, 0, 0, 0] FROM downs JOIN concepts USING (parent)),
 strong AS MATERIALIZED (SELECT query_id, word, max(weight) AS strong, min(pos) AS pos FROM parts WHERE (query_id, word) NOT IN (SELECT (query_id, word) FROM asked) GROUP BY ALL),
 weak AS (SELECT query_id, parent AS word FROM ups JOIN concepts USING (child) UNION SELECT query_id, y.child FROM ups JOIN concepts x USING (child) JOIN concepts y ON y.parent = x.parent WHERE y.child <> ups.word),
 seeds AS (SELECT query_id, word FROM strong WHERE strong >= 0.9 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 5), second AS (SELECT DISTINCT query_id, child AS word FROM seeds JOIN concepts ON parent = word),
 others AS (SELECT query_id, word, CASE WHEN strong IS NOT NULL THEN greatest(strong, CASE WHEN s.word IS NOT NULL THEN 0.5 ELSE 0 END) WHEN s.word IS NOT NULL THEN 0.5 ELSE 0.3 END AS weight FROM strong FULL JOIN weak USING (query_id, word) FULL JOIN (SELECT query_id, word, word AS w FROM second) s USING (query_id, word)),
 best AS (SELECT query_id, word, weight FROM others WHERE (query_id, word) NOT IN (SELECT (query_id, word) FROM asked) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, word) <= <most>)"""


def tables(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    total = turns.count()
    df, pairs = stored(stats.document_frequency(turns, "id", "text")), stored(stats.ppmi(turns, "id", "text"))  # learned once, as tables
    words = df.where("df between 2 and 6").where(F.col("term").rlike("^[a-z]{5,}$")).select(F.col("term").alias("word"))
    begin, end = words.withColumn("p", F.substring("word", 1, 4)), words.withColumn("p", F.expr("right(word, 3)"))
    synonyms = begin.join(begin.groupBy("p").agg(F.min("word").alias("key")), "p").where("word <> key").select("key", F.col("word").alias("synonym"), F.expr("cast(conv(substring(md5(word), 1, 7), 16, 10) as long)").alias("ord"))
    concepts = end.join(end.groupBy("p").agg(F.max("word").alias("parent")), "p").where("word <> parent").select("parent", F.col("word").alias("child"))
    return turns, pairs, df, total, stored(synonyms), stored(concepts)


def clustered(pairs):
    found = graph.components(pairs.where("n >= 2 and pmi >= 3").select(F.col("w1").alias("a"), F.col("w2").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n between 2 and 20").select("component")
    return found.join(sizes, "component", "left_semi").select(F.col("node").alias("word"), F.col("component").alias("cluster"))


def asked(spark, d):
    words = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.regexp_extract_all("text", F.lit("([a-zA-Z]{4,})"), F.lit(1))).alias("pos", "w")).groupBy("query_id", F.lower("w").alias("word")).agg(F.min("pos").alias("pos"))
    return words.selectExpr("query_id", "word", "row_number() over (partition by query_id order by pos) as place").where("place <= 6")


@query("r15_expansion", f"WITH RECURSIVE {EXPANSION.replace('<most>', '10')} SELECT query_id, word, 1.0e0 AS weight FROM asked UNION ALL SELECT query_id, word, round(weight, 6) FROM best")
def _(spark, d):
    _, pairs, df, total, synonyms, concepts = tables(spark, d)
    return expansion.expand(asked(spark, d), pairs, df, total, synonyms, clustered(pairs), concepts).withColumn("weight", F.round("weight", 6))


_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query("r14_field_terms", f"""WITH RECURSIVE {EXPANSION.replace('<most>', '20')}, n AS (SELECT count(*) AS n FROM conversations), i AS (SELECT term AS word, greatest(CASE WHEN n < 20 THEN 0.1e0 ELSE 0.02e0 END, ln(n / df) / ln(n)) AS idf FROM df, n)
 SELECT query_id, word, 1.0e0 AS weight FROM asked UNION ALL SELECT query_id, word, round(weight * greatest(0.3, coalesce(idf, 0.5)), 6) FROM best LEFT JOIN i USING (word) WHERE weight >= 0.15""")
def _(spark, d):
    turns, pairs, df, total, synonyms, concepts = tables(spark, d)
    bound = pairs, df, total, synonyms, clustered(pairs), concepts
    terms = asked(spark, d).withColumn("weight", F.lit(1.0))
    return expansion.field_terms(terms, sorted(STOP_WORDS), lambda q, most: expansion.expand(q, *bound, most=most), stats.idf(turns, "id", "text")).withColumn("weight", F.round("weight", 6))


DIMENSIONS = "dims AS MATERIALIZED (SELECT synonym AS word, 's:' || key AS dimension FROM synonyms UNION SELECT child, 'c:' || parent FROM concepts)"


@query("x11_dimensions", f"WITH RECURSIVE {TABLES}, {DIMENSIONS} SELECT DISTINCT word, dimension FROM dims WHERE word IN (SELECT word FROM asked)")
def _(spark, d):
    *_, synonyms, concepts = tables(spark, d)
    return expansion.dimensions(asked(spark, d), synonyms, concepts)


@query("r5_dimension_overlap", f"""WITH RECURSIVE {TABLES}, {DIMENSIONS}, mw AS (SELECT DISTINCT doc_id AS memory_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')[1:20]) AS word FROM documents), held AS MATERIALIZED (SELECT DISTINCT memory_id, dimension FROM mw JOIN dims USING (word)),
 wanted AS (SELECT DISTINCT query_id, dimension FROM asked JOIN dims USING (word)), w AS MATERIALIZED (SELECT query_id, dimension, 1 / greatest(1, coalesce(n, 1)) AS w FROM wanted LEFT JOIN (SELECT dimension, count(*) AS n FROM held GROUP BY 1) USING (dimension)), whole AS (SELECT query_id, sum(w) AS whole FROM w GROUP BY 1)
 SELECT query_id, memory_id, round(sum(w) / any_value(whole), 6) AS overlap FROM held JOIN w USING (dimension) JOIN whole USING (query_id) GROUP BY query_id, memory_id""")
def _(spark, d):
    *_, synonyms, concepts = tables(spark, d)
    return expansion.dimension_overlap(memories(spark, d), asked(spark, d).withColumn("weight", F.lit(1.0)), synonyms, concepts).withColumn("overlap", F.round("overlap", 6))
