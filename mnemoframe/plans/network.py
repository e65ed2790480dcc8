"""Queries of graph walks, term clusters and the activation field with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import field, graph, stats
from mnemoframe.plans.catalog import CLEAN, EDGES, GRAMS, MEM, _edges, _seeds, query
from mnemoframe.plans.insight import _PAIRS
from mnemoframe.plans.store import NODES, TYPED, nodes, typed_edges
from mnemoframe.sources.tables import memories, read

_TYPE_WEIGHT = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in graph.TYPE_WEIGHTS.items()) + " ELSE 0.8e0 END"
HOPS = f"""{TYPED}, live AS (SELECT source, target, weight * {_TYPE_WEIGHT} * greatest(0.3, exp(-age_days / 90)) AS w FROM tedges WHERE NOT invalid), both_ways AS (SELECT source, target, w FROM live UNION ALL SELECT target, source, w FROM live),
 h1 AS (SELECT target AS node, max(w) AS w FROM both_ways WHERE source IN ('c1', 'c2') AND target NOT IN ('c1', 'c2') GROUP BY 1 ORDER BY w DESC, node LIMIT 10),
 h2 AS (SELECT target AS node, max(w) AS w FROM both_ways WHERE source IN (SELECT node FROM h1) AND target NOT IN ('c1', 'c2') AND target NOT IN (SELECT node FROM h1) GROUP BY 1 ORDER BY w DESC, node LIMIT 10),
 walked AS (SELECT node, 1 AS hop, w FROM h1 UNION ALL (SELECT node, 2, w FROM h2 ORDER BY w DESC, node LIMIT greatest(0, 10 - (SELECT count(*) FROM h1))))"""
INDEX = "ix AS (SELECT doc_id AS memory_id, 'n' || doc_id % 25 AS name FROM documents UNION ALL SELECT doc_id, 'c' || doc_id % 150 FROM documents UNION ALL SELECT doc_id, 's' || doc_id % 100 FROM documents)"


def index(spark, d):
    """Which memory mentions which entity, by a rule, since the tables name no entities."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"))
    return docs.select("memory_id", F.explode(F.expr("array(concat('n', memory_id % 25), concat('c', memory_id % 150), concat('s', memory_id % 100))")).alias("name"))


@query("g2_weighted_hops", f"WITH {HOPS} SELECT node, hop, round(w, 6) AS weight FROM walked")
def _(spark, d):
    return graph.weighted_hops(typed_edges(spark, d), _seeds(spark)).select("node", "hop", F.round("weight", 6).alias("weight"))


# a graph with cycles, parallel edges of other types and edges of a node to itself: from each event's user to the next event's
_KINDS = [*graph.TYPE_WEIGHTS, "leads_to", "other"]
CYCLES = f"""cyc AS MATERIALIZED (SELECT source, target, type, min(event_id) AS ord, 0.5e0 + min(event_id) % 3 AS weight, CASE WHEN min(event_id) % 5 > 0 THEN 0.5e0 + (min(event_id) % 4) / 10.0e0 END AS confidence, CAST(min(event_id) % 120 AS DOUBLE) AS age_days, min(event_id) % 9 = 0 AS invalid
  FROM (SELECT a.event_id, 'u' || a.user_id AS source, 'u' || b.user_id AS target, {_KINDS}[1 + a.event_id % {len(_KINDS)}] AS type FROM events a JOIN events b ON b.event_id = a.event_id + 1) GROUP BY source, target, type),
 users AS (SELECT DISTINCT 'u' || user_id AS name, user_id % 17 = 0 AS invalid FROM events)"""


def cycles(spark, d):
    kinds = ", ".join(f"'{k}'" for k in _KINDS)
    all_of = read(spark, d, "events")
    following = all_of.selectExpr("event_id - 1 as event_id", "concat('u', user_id) as target")
    e = all_of.join(following, "event_id").selectExpr("event_id", "concat('u', user_id) as source", "target", f"get(array({kinds}), cast(pmod(event_id, {len(_KINDS)}) as int)) as type")
    one = e.groupBy("source", "target", "type").agg(F.min("event_id").alias("ord"))
    return one.selectExpr("*", "0.5D + ord % 3 as weight", "if(ord % 5 > 0, 0.5D + (ord % 4) / 10.0D, null) as confidence", "cast(ord % 120 as double) as age_days", "ord % 9 = 0 as invalid")


def users(spark, d):
    return read(spark, d, "events").selectExpr("concat('u', user_id) as name", "user_id % 17 = 0 as invalid").distinct()


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


# breadth first: a hop's nodes by the least path of edge numbers
_WALK = "w{0} AS MATERIALIZED (SELECT there AS node, min(list_append(path, ord)) AS path FROM f{1} JOIN st ON st.here = f{1}.node WHERE there NOT IN (SELECT node FROM seen{1}) GROUP BY there)"


def _bfs(start: str, hops: int, most: int | None) -> str:
    parts = [f"f0 AS (SELECT '{start}' AS node, []::BIGINT[] AS path, 0 AS hop), seen0 AS (SELECT node FROM f0)"]
    for k in range(1, hops + 1):
        cap = f" QUALIFY row_number() OVER (ORDER BY path) <= {most} - (SELECT count(*) - 1 FROM seen{k - 1})" if most else ""
        parts += [_WALK.format(k, k - 1), f"f{k} AS MATERIALIZED (SELECT node, path, {k} AS hop FROM w{k}{cap})", f"seen{k} AS MATERIALIZED (SELECT node FROM seen{k - 1} UNION ALL SELECT node FROM f{k})"]
    return ", ".join(parts)


@query("g3_walk_memories", f"""WITH {CYCLES}, {INDEX.replace("'n' || doc_id % 25", "'u' || doc_id % 150")}, {MEM}, st AS MATERIALIZED (SELECT source AS here, target AS there, ord FROM cyc WHERE NOT invalid UNION ALL SELECT target, source, ord FROM cyc WHERE NOT invalid AND source <> target), {_bfs('u3', 2, 10)}
 SELECT DISTINCT memory_id FROM ix JOIN mem USING (memory_id) WHERE name IN (SELECT node FROM seen2 WHERE node <> 'u3') AND scope NOT IN ('expired', 'decayed') QUALIFY dense_rank() OVER (ORDER BY memory_id) <= 10""")
def _(spark, d):
    named = read(spark, d, "documents").selectExpr("doc_id as memory_id", "concat('u', doc_id % 150) as name")
    return graph.walk_memories(cycles(spark, d), starts(spark, "u3"), named, memories(spark, d))


_RANKED = f"""live AS (SELECT * FROM cyc WHERE NOT invalid AND source IN (SELECT name FROM users WHERE NOT invalid) AND target IN (SELECT name FROM users WHERE NOT invalid)),
 rw AS (SELECT source, target, weight * {_TYPE_WEIGHT} * greatest(0.3, exp(-age_days / 90)) * coalesce(confidence, 0.7) AS w FROM live), s AS MATERIALIZED (SELECT source, target, sum(w) / any_value(total) AS share FROM rw JOIN (SELECT source, sum(w) AS total FROM rw GROUP BY source) USING (source) GROUP BY source, target), p0 AS (SELECT 'u3' AS node, 0.5e0 AS rank UNION ALL SELECT 'u4', 0.5e0)"""
_STEP = "SELECT node, sum(rank) AS rank FROM (SELECT target AS node, 0.85e0 * rank * share AS rank FROM {0} JOIN s ON node = source UNION ALL SELECT node, 0.15e0 * rank FROM p0) GROUP BY node"
_ROUNDS = lambda n: ", ".join(f"p{k} AS MATERIALIZED ({_STEP.format(f'p{k - 1}')})" for k in range(1, n + 1))


@query("g4_pagerank", f"WITH {CYCLES}, {_RANKED}, {_ROUNDS(20)} SELECT node, round(rank, 6) AS rank FROM p20")
def _(spark, d):
    return graph.personalized_pagerank(graph.rank_edges(cycles(spark, d), users(spark, d)), starts(spark, "u3", "u4")).select("node", F.round("rank", 6).alias("rank"))


@query("g5_scored_walk", f"""WITH {CYCLES}, {_RANKED}, {_ROUNDS(10)}, {INDEX.replace("'n' || doc_id % 25", "'u' || doc_id % 150")}, {MEM}, b AS (SELECT source, target FROM cyc WHERE NOT invalid UNION SELECT target, source FROM cyc WHERE NOT invalid),
 near AS (SELECT target AS node FROM b WHERE source = 'u3' UNION SELECT y.target FROM b x JOIN b y ON x.target = y.source WHERE x.source = 'u3'), e AS (SELECT node, rank + CASE WHEN node IN (SELECT node FROM near) THEN 0.3e0 ELSE 0 END AS rank FROM p10 WHERE node NOT IN ('u3', 'u4'))
 SELECT memory_id, round(sum(rank), 5) AS score FROM ix JOIN mem USING (memory_id) JOIN e ON name = node WHERE scope NOT IN ('expired', 'decayed') GROUP BY memory_id QUALIFY row_number() OVER (ORDER BY round(sum(rank), 5) DESC, memory_id) <= 8""")
def _(spark, d):
    e, seeds = cycles(spark, d), starts(spark, "u3", "u4")
    near = graph.k_hop(e.where("not invalid"), seeds.where("node = 'u3'"), 2).where("hop > 0").select("node", F.lit(0.3).alias("bonus"))
    ranked = graph.personalized_pagerank(graph.rank_edges(e, users(spark, d)), seeds, rounds=10).where("node not in ('u3', 'u4')").join(near, "node", "left")
    live = memories(spark, d).where("scope not in ('expired', 'decayed')").select("memory_id", F.expr("concat('u', memory_id % 150)").alias("name"))
    return graph.mentioning(live, ranked, F.col("rank") + F.coalesce("bonus", F.lit(0.0)), 8, 5)


_SPREAD = "SELECT node, sum(a) AS a FROM (SELECT node, a FROM {0} UNION ALL SELECT target, 0.5e0 * a * w FROM {0} JOIN ends ON node = source WHERE a >= 0.01e0) GROUP BY node"


@query("g6_spreading", f"""WITH {CYCLES}, lw AS (SELECT source, target, weight * {_TYPE_WEIGHT.replace('0.8e0 END', '0.7e0 END')} AS w FROM cyc WHERE NOT invalid), ends AS MATERIALIZED (SELECT source, target, w FROM lw UNION ALL SELECT target, source, w FROM lw WHERE source <> target),
 a0 AS (SELECT 'u3' AS node, 1e0 AS a UNION ALL SELECT 'u4', 1e0), a1 AS ({_SPREAD.format('a0')}), a2 AS ({_SPREAD.format('a1')}), a3 AS ({_SPREAD.format('a2')}) SELECT node, round(a, 6) AS activation FROM a3""")
def _(spark, d):
    return graph.spreading(cycles(spark, d), starts(spark, "u3", "u4")).select("node", F.round("activation", 6).alias("activation"))


@query("g7_entity_rank", f"WITH {NODES} SELECT name, round(greatest(0.01, mentions * exp(-idle_days / 30) * (1 + 0.5e0 * CASE WHEN name LIKE 'n%' THEN 1 ELSE 0 END)), 6) AS rank FROM nodes WHERE NOT invalid")
def _(spark, d):
    return graph.entity_rank(nodes(spark, d).withColumn("activation", F.when(F.col("name").startswith("n"), 1.0)))


def _chain(start: str, up: bool) -> str:
    here, there, types = ("target", "source", graph.CAUSES) if up else ("source", "target", graph.EFFECTS)
    rows = " UNION ALL ".join(f"SELECT node, hop, path FROM f{k}" for k in (1, 2, 3))
    return f"""SELECT '{'up' if up else 'down'}' AS way, node, hop, type, round(coalesce(confidence, 0.7) * weight / hop, 6) AS strength FROM (WITH st AS MATERIALIZED (SELECT {here} AS here, {there} AS there, ord FROM cyc WHERE NOT invalid AND type IN {types}), {_bfs(start, 3, None)} {rows}) JOIN cyc ON ord = path[-1]"""


@query("g8_causal_chain", f"WITH {CYCLES} {_chain('u3', True)} UNION ALL {_chain('u4', False)}")
def _(spark, d):
    e = cycles(spark, d)
    up, down = graph.causal_chain(e, starts(spark, "u3"), up=True), graph.causal_chain(e, starts(spark, "u4"), up=False)
    return up.select(F.lit("up").alias("way"), "*").unionByName(down.select(F.lit("down").alias("way"), "*")).withColumn("strength", F.round("strength", 6))


@query("j18_missing_causes", f"WITH {EDGES}, m AS MATERIALIZED (SELECT 'c' || doc_id % 150 AS source, 'n' || doc_id % 25 AS target, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, target FROM m WHERE (source, target) NOT IN (SELECT (source, target) FROM edges) QUALIFY row_number() OVER (ORDER BY n DESC, source, target) <= 10")
def _(spark, d):
    m = read(spark, d, "documents").selectExpr("doc_id as memory_id", "concat('c', doc_id % 150) as cause", "concat('n', doc_id % 25) as effect")
    return graph.missing_causes(m, _edges(spark, d)).select("source", "target")


@query("a10_term_clusters", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT w1 AS a, w2 AS b FROM pmi WHERE n >= 2 AND pmi >= 6), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS v, a AS u FROM b UNION SELECT r.v, b.b FROM r JOIN b ON b.a = r.u), k AS (SELECT v AS node, min(u) AS component FROM r GROUP BY v), s AS (SELECT component, count(*) AS size FROM k GROUP BY component) SELECT node, component FROM k JOIN s USING (component) WHERE size BETWEEN 2 AND 20""")
def _(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    strong = stats.ppmi(turns, "id", "text").where("n >= 2 and pmi >= 6").select(F.col("w1").alias("a"), F.col("w2").alias("b"))
    found = graph.components(strong)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n between 2 and 20").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


# the activation field

QUERY = "When did Licensed Apache users go into the thing under the license of nothing"
_SIGNAL, _STOP = sorted(field.SIGNAL_WORDS), sorted(field.STOP_WORDS)
_STEM_A = "CASE WHEN length(word) < 4 THEN word WHEN word LIKE '%ies' AND length(word) > 4 THEN regexp_replace(word, 'ies$', 'i') WHEN word LIKE '%sses' THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us)$') THEN left(word, length(word) - 1) ELSE word END"
_STEM_B = "CASE WHEN length(word) < 4 OR x LIKE '%eed' THEN x WHEN x LIKE '%ed' AND length(x) > 4 THEN left(x, length(x) - 2) WHEN x LIKE '%ing' AND length(x) > 5 THEN left(x, length(x) - 3) ELSE x END"
_STEM_C = """CASE WHEN length(word) < 4 THEN word WHEN y LIKE '%tion' THEN left(y, length(y) - 4) || 't' WHEN regexp_matches(y, '(ness|ment)$') AND length(y) > 5 THEN left(y, length(y) - 4) WHEN regexp_matches(y, '(ful|ous|ive)$') AND length(y) > 5 THEN left(y, length(y) - 3)
 WHEN regexp_matches(y, '(able|ible)$') AND length(y) > 6 THEN left(y, length(y) - 4) WHEN y LIKE '%ally' AND length(y) > 6 THEN left(y, length(y) - 4) || 'al' WHEN y LIKE '%ly' AND length(y) > 4 THEN left(y, length(y) - 2) ELSE y END"""
_ALL_WORDS = "[" + ", ".join(f"'{w.lower()}'" for w in QUERY.split()) + "]"
FIELD = f"""{MEM}, m AS (SELECT *, list_distinct(list_transform(regexp_extract_all(content, '[a-zA-Z]{{2,}}|[0-9]+'), lambda x: lower(x))) AS t FROM mem WHERE scope NOT IN ('expired', 'decayed') AND length(content) >= 3),
 qw AS (SELECT DISTINCT unnest({_ALL_WORDS}) AS word), vocabulary AS (SELECT DISTINCT unnest(t) AS word FROM m UNION SELECT word FROM qw), sa AS (SELECT word, {_STEM_A} AS x FROM vocabulary), sb AS (SELECT word, {_STEM_B} AS y FROM sa), stems AS MATERIALIZED (SELECT word, {_STEM_C} AS stem FROM sb),
 mw AS MATERIALIZED (SELECT memory_id, word FROM (SELECT memory_id, unnest(t) AS word FROM m) UNION SELECT memory_id, stem FROM (SELECT memory_id, unnest(t) AS word FROM m) JOIN stems USING (word)),
 q0 AS (SELECT word, stem, CASE WHEN list_contains({_SIGNAL}, word) THEN 0.5e0 WHEN list_contains({_STOP}, word) THEN 0.1e0 ELSE 1 END AS weight FROM qw JOIN stems USING (word)),
 terms AS MATERIALIZED (SELECT word, weight FROM q0 UNION SELECT stem, min(weight) FROM q0 WHERE stem NOT IN (SELECT word FROM q0) GROUP BY stem),
 e AS (SELECT memory_id, greatest(age_days * 86400e0, 1e0) AS c, greatest(access_age_days * 86400e0, 1e0) AS l, least(greatest(recall_count, 1), 20) AS n FROM m),
 base AS MATERIALIZED (SELECT memory_id, 1 / (1 + exp(-ln(list_sum(list_transform(range(0, n), lambda i: pow(greatest(c - (CASE WHEN n > 1 THEN i / (n - 1) ELSE 1e0 END) * (c - l), 1e0), -0.5e0)))) - 1)) AS base FROM e),
 corpus AS (SELECT count(*) AS n, avg(len(regexp_extract_all(content, '[一-鿿]|[a-zA-Z]+'))) AS mean FROM m),
 figures AS MATERIALIZED (SELECT terms.word, any_value(weight) AS weight, CASE WHEN count(mw.memory_id) = 0 THEN 1 ELSE greatest(0.02e0, ln(any_value(n) / count(mw.memory_id)) / ln(any_value(n))) END AS idf, coalesce(sum(base), 0) AS mass FROM terms CROSS JOIN corpus LEFT JOIN mw ON mw.word = terms.word LEFT JOIN base ON base.memory_id = mw.memory_id GROUP BY terms.word),
 tstems AS (SELECT word, stem FROM stems WHERE word IN (SELECT word FROM terms) UNION SELECT word, word FROM terms),
 sizes AS (SELECT memory_id, count(*) AS size FROM mw GROUP BY memory_id),
 v AS (SELECT m.memory_id, f.word, f.weight, f.weight * f.idf * (1 + 0.5e0 * CASE WHEN f.mass > 0 THEN base / f.mass ELSE 0 END) AS eff, 1.5e0 * 2.5e0 / 2.5e0 AS k1, coalesce(size, 0) AS size, mean FROM m JOIN base USING (memory_id) LEFT JOIN sizes USING (memory_id) CROSS JOIN corpus CROSS JOIN figures f),
 hit AS MATERIALIZED (SELECT DISTINCT mw.memory_id, s.word FROM mw JOIN tstems s ON s.stem = mw.word),
 h AS MATERIALIZED (SELECT v.*, hit.word IS NOT NULL AS found, eff * 2.5e0 / (1 - 0.336675e0 + 0.336675e0 * size / mean + 1.5e0) + 1.5e0 AS value, eff + 1.5e0 AS most FROM v LEFT JOIN hit ON hit.memory_id = v.memory_id AND hit.word = v.word),
 w AS MATERIALIZED (SELECT memory_id, coalesce(sum(value) FILTER (found AND weight >= 0.9), 0) / greatest(0.01, sum(most) FILTER (weight >= 0.9)) + 0.5e0 * coalesce(sum(value) FILTER (found AND weight < 0.9), 0) / greatest(0.01, sum(most) FILTER (weight < 0.9)) AS first,
  0.7e0 * coalesce(sum(value) FILTER (found), 0) / sum(most) AS second, greatest(0.005, 1 / count(*)) AS least FROM h GROUP BY memory_id),
 p AS MATERIALIZED (SELECT memory_id, (SELECT sum(CAST(contains(lower(content), a || ' ' || b) OR contains(lower(content), a || b) AS INT)) FROM (SELECT unnest({_ALL_WORDS}[1:-2]) AS a, unnest({_ALL_WORDS}[2:]) AS b)) + 2 * (SELECT sum(CAST(contains(lower(content), a || ' ' || b || ' ' || c) AS INT)) FROM (SELECT unnest({_ALL_WORDS}[1:-3]) AS a, unnest({_ALL_WORDS}[2:-2]) AS b, unnest({_ALL_WORDS}[3:]) AS c)) AS hits FROM m),
 qg AS MATERIALIZED (SELECT unnest({GRAMS.format(f"lower('{QUERY}')")}) AS gram), ch AS MATERIALIZED (SELECT memory_id, string_split({CLEAN.format('content')}, '') AS c FROM m),
 cg AS MATERIALIZED (SELECT DISTINCT memory_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM ch),
 g AS MATERIALIZED (SELECT memory_id, count(cg.gram) AS n, count(qg.gram) AS k, (SELECT count(*) FROM qg) AS q FROM m LEFT JOIN cg USING (memory_id) LEFT JOIN qg ON qg.gram = cg.gram GROUP BY memory_id),
 c AS (SELECT memory_id, contains(lower(content), 'licensed') OR contains(lower(content), 'apache') AS named, len(list_filter(['users', 'thing', 'under', 'license', 'nothing'], lambda x: contains(lower(content), x) OR contains(lower(content), CASE x WHEN 'users' THEN 'user' ELSE CASE x WHEN 'nothing' THEN 'noth' ELSE x END END))) AS k FROM m),
 r1 AS (SELECT memory_id, list_reverse_sort([CASE WHEN greatest(first, second) < least THEN 0 ELSE greatest(first, second) END, 1.2e0 * hits / {2 * len(QUERY.split()) - 3}e0, g.k / (g.n + g.q - g.k), CASE WHEN named THEN 0.9e0 * least(0.8, c.k / 5e0) ELSE 0 END]) AS s FROM w JOIN p USING (memory_id) JOIN g USING (memory_id) JOIN c USING (memory_id)),
 ctx AS (SELECT memory_id, s[1] + CASE WHEN s[2] > 0.05 THEN 0.15e0 * s[2] ELSE 0 END AS context FROM r1),
 act AS (SELECT m.memory_id, context, (0.15e0 * base + 0.85e0 * context) * (0.5e0 + 0.5e0 * least(1, 0.5e0 * (1 + 0.5e0 * emotion_intensity))) * 0.9e0 * (0.6e0 + 0.4e0 * confidence) * (1 + greatest(0, importance - 5) * 0.05e0) * CASE WHEN scope = 'correction' THEN 1.5e0 ELSE 1 END * CASE WHEN superseded THEN 0.3e0 ELSE 1 END AS activation
  FROM m JOIN ctx USING (memory_id) JOIN base USING (memory_id) WHERE context >= 0.002)"""


@query("r1_context_match", f"WITH {FIELD} SELECT memory_id, round(context, 5) AS context FROM ctx")
def _(spark, d):
    return field.context_match(memories(spark, d), QUERY).select("memory_id", F.round("context", 5).alias("context"))


@query("r11_activation_field", f"WITH {FIELD} SELECT memory_id, round(context, 5) AS context, round(activation, 5) AS activation FROM act WHERE activation > 0.001")
def _(spark, d):
    return field.activation_field(memories(spark, d), QUERY).select("memory_id", F.round("context", 5).alias("context"), F.round("activation", 5).alias("activation"))


@query("r13_recall")
def _(spark, d):
    return field.recall(memories(spark, d), QUERY).withColumn("activation", F.round("activation", 5))


WANTED = "wanted AS (SELECT * FROM (VALUES (1, 10), (2, 23), (3, 31)) v(query_id, memory_id))"


@query("r35_evaluation", f"WITH {MEM}, {WANTED}, r AS (SELECT q AS query_id, memory_id, row_number() OVER (PARTITION BY q ORDER BY importance * q + memory_id % (5 + q) DESC, memory_id) AS place FROM mem, (SELECT unnest([1, 2, 3]) AS q) WHERE memory_id < 40), f AS (SELECT query_id, min(place) AS p FROM wanted LEFT JOIN (SELECT * FROM r WHERE place <= 10) USING (query_id, memory_id) GROUP BY query_id) SELECT count(*) AS queries, round(avg(CAST(p IS NOT NULL AS INT)), 6) AS hit_rate, round(avg(coalesce(1 / p, 0)), 6) AS mrr FROM f")
def _(spark, d):
    q = memories(spark, d).where("memory_id < 40").select("memory_id", "importance", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("query_id"))
    ranked = q.withColumn("place", F.expr("row_number() over (partition by query_id order by importance * query_id + memory_id % (5 + query_id) desc, memory_id)"))
    return field.evaluation(ranked, spark.createDataFrame([(1, 10), (2, 23), (3, 31)], "query_id int, memory_id long"))
