"""Queries of the memory store with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import store
from mnemoframe.plans.catalog import FACTS, MEM, _facts, query
from mnemoframe.plans.signals import TEXTS, texts
from mnemoframe.sources.tables import memories, read


def versioned(spark, d):
    """Facts with valid_until: the time of the next fact of the subject and predicate."""
    return _facts(spark, d).withColumn("valid_until", F.expr("lead(ts) over (partition by subject, predicate order by ts, fact_id)"))


VERSIONED = f"{FACTS}, versioned AS (SELECT *, lead(ts) OVER (PARTITION BY subject, predicate ORDER BY ts, fact_id) AS valid_until FROM facts)"


@query("s2_find_by_content", f"WITH {MEM} SELECT memory_id FROM mem WHERE content = (SELECT max(text) FROM documents WHERE doc_id = 11) AND scope <> 'expired' ORDER BY memory_id LIMIT 1")
def _(spark, d):
    wanted = read(spark, d, "documents").where("doc_id = 11").agg(F.max("text")).first()[0]
    return store.find_by_content(memories(spark, d), wanted).select("memory_id")


@query("s4_facts_by_spo", f"WITH {VERSIONED} SELECT fact_id FROM versioned WHERE subject = '7' AND predicate = 'click' AND contains(object, '1') AND valid_until IS NULL UNION ALL SELECT fact_id FROM versioned WHERE contains(object, '3') AND valid_until IS NULL")
def _(spark, d):
    f = versioned(spark, d)
    return store.find_facts(f, "7", "click", "1").unionAll(store.find_facts(f, part_of_object="3")).select("fact_id")


@query("s5_facts_of_subject", f"WITH {VERSIONED} SELECT fact_id, predicate, object FROM versioned WHERE subject = '7' AND valid_until IS NULL")
def _(spark, d):
    return store.find_facts(versioned(spark, d), "7").orderBy(F.desc("ts"), "fact_id").select("fact_id", "predicate", "object")


@query("s6_all_facts", f"WITH {VERSIONED} SELECT fact_id, subject, predicate, object, valid_until IS NULL AS valid FROM versioned")
def _(spark, d):
    return store.find_facts(versioned(spark, d), valid_only=False).select("fact_id", "subject", "predicate", "object", F.col("valid_until").isNull().alias("valid"))


@query("s7_recent_history", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 30")
def _(spark, d):
    return store.latest(read(spark, d, "conversations"), [F.desc("conv_id"), F.desc("turn")]).select("conv_id", "turn", "role")


HUB = "hub AS (SELECT substring(sha256(text), 1, 16) AS content_hash, doc_id % 6 AS instance, CAST(doc_id AS DOUBLE) AS received_at FROM documents WHERE doc_id % 10 = 3 AND text IS NOT NULL)"


def hub(spark, d):
    return read(spark, d, "documents").where("doc_id % 10 = 3 and text is not null").select(F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), (F.col("doc_id") % 6).alias("instance"), F.col("doc_id").cast("double").alias("received_at"))


@query("s12_hub_upload", f"WITH {HUB}, h AS (SELECT min(doc_id) AS doc_id, substring(sha256(text), 1, 16) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY 2) SELECT doc_id, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM hub)")
def _(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return store.hub_upload(rows, hub(spark, d), "text", ["doc_id"]).select("doc_id", "content_hash")


@query("s12_hub_download", f"WITH {HUB} SELECT content_hash, instance FROM hub WHERE received_at >= 50 AND instance <> 1 ORDER BY received_at, content_hash LIMIT 1000")
def _(spark, d):
    return store.hub_download(hub(spark, d), 1, 50.0).select("content_hash", "instance")


@query("s15_keyword_search", f"""WITH {MEM} SELECT memory_id, round((CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'license') AS INT) + CAST(contains(lower(content), 'token') AS INT)) / 3e0
 * CASE scope WHEN 'archived' THEN 0.3e0 WHEN 'correction' THEN 1.5e0 WHEN 'fact' THEN 1.3e0 WHEN 'preference' THEN 1.3e0 ELSE 1 END, 6) AS score FROM mem WHERE content IS NOT NULL QUALIFY row_number() OVER (ORDER BY score DESC, memory_id) <= 10""")
def _(spark, d):
    return store.keyword_search(memories(spark, d), ["the", "license", "token"])


@query("k4_chat_trim", "SELECT conv_id, turn, length(CASE WHEN role = 'user' THEN left(text, 200) ELSE left(text, 400) END) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def _(spark, d):
    return store.trimmed_chat(read(spark, d, "conversations"), "conv_id", "turn", 3, 200, 400).select("conv_id", "turn", F.length("text").alias("n"))


@query("k5_cleanup", f"WITH {MEM} SELECT memory_id FROM mem WHERE NOT (scope = 'expired' AND age_days > 30)")
def _(spark, d):
    return store.without_long_expired(memories(spark, d)).select("memory_id")


ENTITIES = "ent AS (SELECT 'u' || user_id AS name, count(*) // 40 AS mentions, CAST(user_id % 200 AS DOUBLE) AS idle_days, user_id % 9 = 0 AS invalid FROM events GROUP BY user_id)"
TYPED = """tedges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, ['caused_by', 'uses', 'related_to', 'follows'][1 + c_custkey % 4] AS type, 1.0e0 + c_custkey % 3 AS weight, CAST(c_custkey % 120 AS DOUBLE) AS age_days, c_custkey % 11 = 0 AS invalid FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1.0e0, 10e0, false FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'triggers', 0.5e0 + s_suppkey % 2, CAST(s_suppkey % 100 AS DOUBLE), false FROM supplier)"""


def entities(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.expr("count(*) div 40").alias("mentions")).select(F.concat(F.lit("u"), "user_id").alias("name"), "mentions", (F.col("user_id") % 200).cast("double").alias("idle_days"), (F.col("user_id") % 9 == 0).alias("invalid"))


def typed_edges(spark, d):
    """Customer to nation, nation to region and nation to supplier as typed, weighted, dated edges."""
    c, n, s = (read(spark, d, t) for t in ("customer", "nation", "supplier"))
    one = c.selectExpr("concat('c', c_custkey) as source", "concat('n', c_nationkey) as target", "element_at(array('caused_by', 'uses', 'related_to', 'follows'), cast(1 + c_custkey % 4 as int)) as type", "1.0D + c_custkey % 3 as weight", "cast(c_custkey % 120 as double) as age_days", "c_custkey % 11 = 0 as invalid")
    two = n.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "'part_of'", "1.0D", "10.0D", "false")
    three = s.selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)", "'triggers'", "0.5D + s_suppkey % 2", "cast(s_suppkey % 100 as double)", "false")
    return one.unionAll(two).unionAll(three)


@query("s8_entities", f"WITH {ENTITIES} SELECT name, mentions, row_number() OVER (ORDER BY mentions DESC, name) AS place FROM ent QUALIFY place <= 50")
def _(spark, d):
    top = store.latest(entities(spark, d), [F.desc("mentions"), F.col("name")], 50)
    return top.select("name", "mentions", F.expr("row_number() over (order by mentions desc, name)").alias("place"))  # at most 50 rows


@query("k6_entity_upsert", """WITH b AS (SELECT 'u' || user_id AS name, count(*) AS mentions, ['base'] AS attrs, user_id % 2 = 0 AS invalid FROM events WHERE user_id % 3 = 0 GROUP BY user_id),
 s AS (SELECT 'u' || user_id AS name, count(*) AS n, list_distinct(list(event_type)) AS attrs FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
 SELECT coalesce(b.name, s.name) AS name, coalesce(mentions, 0) + coalesce(n, 0) AS mentions, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.attrs, []), coalesce(s.attrs, [])))), ' ') AS attrs, coalesce(invalid, false) AND n IS NULL AS invalid FROM b FULL JOIN s ON b.name = s.name""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("name", F.concat(F.lit("u"), "user_id"))
    base = e.where("user_id % 3 = 0").groupBy("name", "user_id").agg(F.count("*").alias("mentions")).select("name", "mentions", F.array(F.lit("base")).alias("attrs"), (F.col("user_id") % 2 == 0).alias("invalid"))
    return store.upserted_entities(base, e.where("user_id % 2 = 0").select("name", F.col("event_type").alias("attr"))).withColumn("attrs", F.array_join("attrs", " "))


NODES = "nodes AS (SELECT 'c' || c_custkey AS name, c_custkey % 3 AS mentions, CAST(c_custkey % 200 AS DOUBLE) AS idle_days, false AS invalid FROM customer UNION ALL SELECT 'n' || n_nationkey, 5, 0e0, false FROM nation)"


def nodes(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.selectExpr("concat('c', c_custkey) as name", "c_custkey % 3 as mentions", "cast(c_custkey % 200 as double) as idle_days", "false as invalid").unionAll(n.selectExpr("concat('n', n_nationkey)", "5L", "0.0D", "false"))


@query("k8_invalidation", f"""WITH {NODES}, {TYPED}, g AS (SELECT name FROM nodes WHERE invalid OR (idle_days > 90 AND mentions <= 1))
 SELECT source, target, type, invalid OR source IN (SELECT name FROM g) OR target IN (SELECT name FROM g) OR age_days > 90 AS invalid FROM tedges""")
def _(spark, d):
    return store.invalidated(nodes(spark, d), typed_edges(spark, d))[1].select("source", "target", "type", "invalid")


@query("k9_entity_trim", f"WITH {NODES}, n AS (SELECT *, name LIKE '%7' AS gone FROM nodes) SELECT name FROM n QUALIFY row_number() OVER (ORDER BY gone, (mentions + 1) / (1 + idle_days / 30) DESC, name) <= 100")
def _(spark, d):
    return store.trimmed_entities(nodes(spark, d).withColumn("invalid", F.col("name").endswith("7")), 100).select("name")


@query("p2_tenant", f"WITH {MEM} SELECT memory_id FROM mem WHERE user_id = 7 QUALIFY row_number() OVER (ORDER BY confidence DESC, memory_id) <= 5")
def _(spark, d):
    """Tenant rows are chosen before the best are cut, so a tenant with enough rows gets them."""
    return store.latest(memories(spark, d).where("user_id = 7"), [F.desc("confidence"), F.col("memory_id")], 5).select("memory_id")


@query("p4_learned_exclusion", f"WITH {MEM} SELECT memory_id FROM mem WHERE NOT (recall_count >= 5 AND memory_id % 3 = 0)")
def _(spark, d):
    rows = memories(spark, d).withColumn("miss_count", F.col("recall_count")).withColumn("engaged_count", F.col("memory_id") % 3)
    return store.learned_exclusion(rows).select("memory_id")


@query("p5_superseded", f"WITH {MEM} SELECT memory_id FROM mem WHERE NOT superseded")
def _(spark, d):
    return store.not_superseded(memories(spark, d), False).select("memory_id")


@query("p6_route", f"""WITH {MEM}, a AS (SELECT *, user_id = 7 AS own, user_id = 7 AND age_days <= 100 AS recent, contains(lower(content), 'the') OR contains(lower(content), 'la') AS named FROM mem),
 n AS (SELECT count(*) AS n, count(*) FILTER (recent) AS r, count(*) FILTER (own) AS o, count(*) FILTER (recent AND named) AS rn, count(*) FILTER (own AND named) AS o_n FROM a),
 c AS (SELECT a.*, n.n, CASE WHEN r >= 5 THEN recent AND (coalesce(named, false) OR rn < greatest(150, 0.3e0 * r)) ELSE own AND (coalesce(named, false) OR o_n < greatest(150, 0.3e0 * o)) END AS chosen FROM a, n),
 k AS (SELECT count(*) AS k FROM c WHERE chosen), x AS (SELECT memory_id, row_number() OVER (ORDER BY age_days, memory_id) AS p FROM c WHERE NOT chosen)
 SELECT memory_id FROM c WHERE chosen OR n < 800 UNION ALL SELECT memory_id FROM x, k WHERE (SELECT n FROM n) >= 800 AND p <= 150 - k""")
def _(spark, d):
    return store.routed(memories(spark, d), 7, 100.0, ["the", "la"]).select("memory_id")


LORE = [(1, "Coffee", 5), (1, "咖啡", 5), (2, "raft", 9), (3, "the", 1), (4, "bug", 7), (5, "docker", 3), (6, "to", 2), (7, "and", 2), (8, "in", 1), (9, "er", 1)]


@query("p18_lorebook", f"""WITH {TEXTS}, lore AS (SELECT * FROM (VALUES {', '.join(f"({a}, '{b}', {c})" for a, b, c in LORE)}) v(trigger_id, keyword, priority)),
 h AS (SELECT DISTINCT id, trigger_id, priority FROM texts JOIN lore ON contains(lower(text), lower(keyword))) SELECT id, trigger_id FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority DESC, trigger_id) <= 5""")
def _(spark, d):
    return store.triggered(texts(spark, d), spark.createDataFrame(LORE, "trigger_id int, keyword string, priority int"), 5)


@query("p19_prospective", """WITH m AS (SELECT event_id AS id, user_id, ts, event_type || ' ' || props AS text FROM events), r AS (SELECT user_id AS reminder_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'purchase' ELSE 'error' END AS keyword,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-20' END AS expires_at FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0)),
 h AS (SELECT reminder_id, id, ts, row_number() OVER (PARTITION BY reminder_id ORDER BY ts, id) AS k FROM r JOIN m USING (user_id) WHERE contains(text, keyword) AND (expires_at IS NULL OR ts < expires_at)) SELECT reminder_id, id, ts FROM h WHERE k = 1""")
def _(spark, d):
    m = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    users = m.select("user_id").distinct()
    r = users.select(F.col("user_id").alias("reminder_id"), "user_id", F.expr("if(user_id % 2 = 0, 'purchase', 'error')").alias("keyword"), F.expr("if(user_id % 5 = 0, null, timestamp '2024-01-20')").alias("expires_at"), F.expr("if(user_id % 7 = 0, timestamp '2024-01-01', null)").alias("fired_at"))
    return store.fired_reminders(m, r)


@query("p20_reminders", f"WITH {TEXTS} SELECT DISTINCT id, trigger_id FROM texts JOIN (VALUES (1, 'meeting'), (2, 'deadline'), (3, 'the')) r(trigger_id, keyword) ON contains(lower(text), keyword)")
def _(spark, d):
    return store.triggered(texts(spark, d), spark.createDataFrame([(1, "meeting", 1), (2, "deadline", 1), (3, "the", 1)], "trigger_id int, keyword string, priority int"))


@query("l7_versions", "SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER w AS valid_until, row_number() OVER w AS version FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def _(spark, d):
    return store.versions(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "valid_from", "valid_until", "version")


WRITES = "writes AS (SELECT event_id AS fact_id, CAST(user_id AS VARCHAR) AS subject, CASE WHEN event_type = 'view' THEN 'likes' ELSE event_type END AS predicate, repeat('ab', CAST(1 + event_id % 4 AS INT)) || CAST(event_id % 3 AS VARCHAR) AS object, 0.5e0 + (event_id % 5) / 10.0e0 AS confidence, ts FROM events)"


@query("l3_supersession", f"""WITH RECURSIVE {WRITES}, o AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ts, fact_id) AS k FROM writes),
 r AS (SELECT fact_id, subject, predicate, ts, k, object AS open_object, confidence AS open_confidence, true AS written FROM o WHERE k = 1 AND predicate <> 'likes'
  UNION ALL SELECT o.fact_id, o.subject, o.predicate, o.ts, o.k, CASE WHEN w THEN o.object ELSE open_object END, CASE WHEN w THEN o.confidence ELSE open_confidence END, w
  FROM (SELECT r.subject AS s, r.predicate AS p, r.k AS rk, r.open_object, r.open_confidence, o.*, o.object <> r.open_object AND NOT (length(o.object) < 0.5e0 * length(r.open_object) AND r.open_confidence >= o.confidence) AS w FROM r JOIN o ON o.subject = r.subject AND o.predicate = r.predicate AND o.k = r.k + 1) o),
 a AS (SELECT fact_id, written, CASE WHEN written THEN (SELECT NULL) END AS x, subject, predicate, ts, k FROM r),
 v AS (SELECT fact_id, written, CASE WHEN written THEN min(CASE WHEN written THEN ts END) OVER (PARTITION BY subject, predicate ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS valid_until FROM a),
 l AS (SELECT fact_id, row_number() OVER (PARTITION BY subject, object ORDER BY ts, fact_id) = 1 AS written, NULL::TIMESTAMP AS valid_until FROM writes WHERE predicate = 'likes')
 SELECT fact_id, written, valid_until FROM v UNION ALL SELECT fact_id, written, valid_until FROM l""")
def _(spark, d):
    w = read(spark, d, "events").selectExpr("event_id as fact_id", "cast(user_id as string) as subject", "if(event_type = 'view', 'likes', event_type) as predicate", "concat(repeat('ab', cast(1 + event_id % 4 as int)), event_id % 3) as object", "0.5D + (event_id % 5) / 10.0D as confidence", "ts")
    return store.superseded(w).select("fact_id", "written", "valid_until")
