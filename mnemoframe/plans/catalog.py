"""Registry of the engine's queries with their oracle SQL.

Keys begin with the operator's inventory number. Every query runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import scores as S
from mnemoframe.functions import text as T
from mnemoframe.operators import behavior, facts, graph, lifecycle, recall, stats
from mnemoframe.sources.tables import MEMORY_COLUMNS, memories, read

NOW = "2024-01-31 00:00:00"
MEM = f"mem AS (SELECT {', '.join(MEMORY_COLUMNS)} FROM documents)"
FACT_COLUMNS = ["event_id AS fact_id", "CAST(user_id AS VARCHAR(20)) AS subject", "event_type AS predicate", "CAST(event_id % 5 AS VARCHAR(20)) AS object", "ts"]
FACTS = f"facts AS (SELECT {', '.join(FACT_COLUMNS)} FROM events)"
#: Pieces of oracle SQL.
LATIN = "list_transform(regexp_extract_all({}, '[a-zA-Z]{{2,}}|[0-9]+'), lambda x: lower(x))"
GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substring({0}, i, 3)))"
CLEAN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"
WORDS = ["the", "with", "la", "der"]

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(*[c.replace("VARCHAR(20)", "STRING") for c in FACT_COLUMNS])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to nation and nation to region as a small typed graph, suppliers to nations."""
    c, n, s = (read(spark, d, t) for t in ("customer", "nation", "supplier"))
    one = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), (1.0 + F.col("c_custkey") % 3).alias("weight"))
    two = n.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit(1.0).alias("weight"))
    three = s.select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"), (0.5 + F.col("s_suppkey") % 2).alias("weight"))
    return one.unionAll(two).unionAll(three)


EDGES = """edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 1.0e0 + c_custkey % 3 AS weight FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0e0 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.5e0 + s_suppkey % 2 FROM supplier)"""


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c1",), ("c2",)], "node string")


# scans and predicates


@query("s3_time_range", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return read(spark, d, "events").where("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "event_type")


@query("s1_live_scan", f"WITH {MEM} SELECT memory_id, scope FROM mem WHERE scope <> 'expired'")
def _(spark, d):
    return memories(spark, d).where("scope <> 'expired'").select("memory_id", "scope")


@query("p1_visibility", f"WITH {MEM} SELECT memory_id FROM mem WHERE NOT (visibility = 'channel' AND coalesce(channel_id, 3) <> 3) AND NOT (visibility = 'private' AND coalesce(user_id, 7) <> 7)")
def _(spark, d):
    return memories(spark, d).where(recall.visible(7, 3)).select("memory_id")


@query("p9_pii", r"SELECT doc_id, regexp_matches(text, '\b1[3-9]\d{9}\b') OR regexp_matches(text, '\b\d{17}[\dXx]\b') OR regexp_matches(text, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b') OR regexp_matches(text, '(?i)\b(?:sk-|api[_-]?key|token|secret|password)[=:]\s*\S+') OR regexp_matches(text, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b') AS has_pii FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.matches_any(F.col("text"), T.PII).alias("has_pii"))


# text functions


@query("t1_tokens", f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct({LATIN.format('text')})), ' ') AS tokens FROM conversations")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(T.tokens(F.col("text"))), " ").alias("tokens"))


@query("t3_trigram_jaccard", f"""WITH t AS (SELECT conv_id, turn, CASE WHEN length({CLEAN.format('text')}) >= 3 THEN {GRAMS.format(CLEAN.format('text'))} ELSE [] END AS g FROM conversations),
 p AS (SELECT conv_id, turn, g, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM t)
 SELECT conv_id, turn, round(CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0e0 ELSE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) END, 6) AS similarity FROM p WHERE h IS NOT NULL""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("g", T.trigrams(F.col("text"))).withColumn("h", F.lag("g").over(w)).where("h is not null")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("t5_dice", f"""WITH t AS (SELECT conv_id, turn, list_distinct({LATIN.format('text')}) AS g FROM conversations), p AS (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM t)
 SELECT conv_id, turn, round(CASE WHEN len(g) + len(h) = 0 THEN 0.0e0 ELSE 2.0e0 * len(list_intersect(g, h)) / (len(g) + len(h)) END, 6) AS dice FROM p WHERE h IS NOT NULL""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("g", T.overlap_words(F.col("text"))).withColumn("h", F.lag("g").over(w)).where("h is not null")
    return rows.select("conv_id", "turn", F.round(T.dice(F.col("g"), F.col("h")), 6).alias("dice"))


@query("t25_token_estimate", "SELECT doc_id, CAST(ceil(0.4e0 * length(text)) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("t26_strip_html", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
 SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?i)&nbsp;', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))) AS digest FROM a""")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


# statistics


@query("a1_idf", f"""WITH t AS (SELECT DISTINCT doc_id, unnest({LATIN.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
 SELECT term, df, round(greatest(CASE WHEN n < 20 THEN 0.1e0 ELSE 0.02e0 END, ln(n / df) / ln(n)), 6) AS idf, round(ln(n / (1 + df)), 6) AS bm25_idf FROM f, n""")
def _(spark, d):
    return stats.idf(read(spark, d, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"), F.round("bm25_idf", 6).alias("bm25_idf"))


PPMI = f"""t AS (SELECT conv_id, turn, {LATIN.format('text')} AS t FROM conversations),
 p AS (SELECT DISTINCT conv_id, turn, least(t[i], t[i + k]) AS w1, greatest(t[i], t[i + k]) AS w2 FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM t), (SELECT unnest(range(1, 5)) AS k) WHERE i + k <= len(t) AND t[i] <> t[i + k]),
 c AS (SELECT w1, w2, least(50, count(*)) AS n FROM p GROUP BY ALL), u AS (SELECT DISTINCT conv_id, turn, unnest(t) AS w FROM t), f AS (SELECT w, count(*) AS df FROM u GROUP BY w),
 m AS (SELECT w1, w2, n, greatest(0.0e0, log2(n * (SELECT count(*) FROM conversations) / (a.df * b.df))) AS pmi FROM c JOIN f a ON a.w = w1 JOIN f b ON b.w = w2)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text", "conv_id", "turn")


@query("a7_ppmi", f"WITH {PPMI} SELECT w1, w2, n, round(pmi, 6) AS pmi FROM m")
def _(spark, d):
    return stats.ppmi(_turns(spark, d), "key", "text").select("w1", "w2", "n", F.round("pmi", 6).alias("pmi"))


@query("a8_neighbours", f"""WITH {PPMI}, b AS (SELECT w1 AS word, w2 AS neighbour, round(pmi, 6) AS pmi FROM m WHERE round(pmi, 6) > 0.5 UNION ALL SELECT w2, w1, round(pmi, 6) FROM m WHERE round(pmi, 6) > 0.5),
 r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pmi DESC, neighbour) AS rank, count(*) OVER (PARTITION BY neighbour) AS fan_out FROM b) SELECT word, neighbour, pmi, rank, fan_out FROM r WHERE rank <= 10""")
def _(spark, d):
    return stats.neighbours(stats.ppmi(_turns(spark, d), "key", "text").withColumn("pmi", F.round("pmi", 6)))


@query("a11_succession", f"""WITH t AS (SELECT conv_id, turn, {LATIN.format('text')} AS l FROM conversations), u AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS w FROM t),
 s AS (SELECT w, lag(w[1:10]) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM u) , e AS (SELECT unnest(b) AS word, w FROM s WHERE b IS NOT NULL), g AS (SELECT word, unnest(w) AS next_word FROM e) SELECT word, next_word, count(*) AS n FROM g GROUP BY ALL""")
def _(spark, d):
    return stats.succession(read(spark, d, "conversations"), "conv_id", "turn", "text")


# retrieval


def _weibull(scope: str, age: str, lam: str) -> str:
    return f"(CASE WHEN {scope} = 'correction' OR {age} <= 0 THEN 1.0e0 ELSE exp(-pow({age} / ({lam}), 1.2e0)) END)"


LAM = "(CASE scope WHEN 'fact' THEN 30e0 WHEN 'preference' THEN 90e0 WHEN 'episode' THEN 14e0 ELSE 30e0 END)"
EFFECTIVE = f"{LAM} * least(1 + 0.15e0 * recall_count, 3e0) * (1 + 1.5e0 * emotion_intensity * emotion_intensity)"
TIER = "(CASE WHEN access_age_days <= 1 OR recall_count >= 5 THEN 1.5e0 WHEN access_age_days <= 7 THEN 1e0 WHEN access_age_days <= 30 THEN 0.8e0 ELSE 0.5e0 END)"
SIM = "((" + " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in WORDS) + f") / {len(WORDS)}e0 * 0.7e0)"


@query("r28_tag_recall", f"""WITH {MEM}, v AS (SELECT * FROM mem WHERE NOT (visibility = 'channel' AND coalesce(channel_id, 3) <> 3) AND NOT (visibility = 'private' AND coalesce(user_id, 7) <> 7) AND scope NOT IN ('expired', 'decayed')),
 a AS (SELECT * FROM v ORDER BY age_days, memory_id LIMIT 500), b AS (SELECT * FROM v WHERE emotion = 'important' OR scope IN ('correction', 'consolidated') ORDER BY age_days, memory_id LIMIT 100), u AS (SELECT * FROM a UNION SELECT * FROM b)
 SELECT memory_id, scope, round({SIM} * {_weibull('scope', 'age_days', LAM)} * (CASE WHEN scope IN ('preference', 'fact') THEN 1.3e0 WHEN scope IN ('correction', 'consolidated') THEN 1.5e0 ELSE 1e0 END) * (CASE emotion WHEN 'important' THEN 1.4e0 WHEN 'painful' THEN 1.3e0 WHEN 'warm' THEN 1.2e0 ELSE 1e0 END)
 * (CASE WHEN user_id = 7 THEN 1.3e0 ELSE 1e0 END) * confidence * (CASE WHEN scope = 'archived' THEN 0.3e0 ELSE 1e0 END) * (CASE WHEN scope = 'consolidated' THEN 1.5e0 ELSE 1e0 END) * {TIER} * (CASE WHEN superseded THEN 0.3e0 ELSE 1e0 END), 6) AS score
 FROM u WHERE {SIM} >= 0.05 ORDER BY score DESC, memory_id LIMIT 20""")
def _(spark, d):
    return recall.tag_recall(memories(spark, d), WORDS, 7, 3)


@query("r27_dirichlet", f"""WITH d AS (SELECT doc_id, unnest({LATIN.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
 cf AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest({LATIN.format('text')}) AS term FROM benchmark),
 m AS (SELECT query_id, term, 2000e0 * coalesce(cf, 1) / (SELECT sum(tf) FROM tf) AS mass FROM q LEFT JOIN cf USING (term)), w AS (SELECT query_id, sum(ln(mass)) AS base, count(*) AS ql FROM m GROUP BY ALL),
 h AS (SELECT query_id, doc_id, sum(ln((tf + mass) / mass)) AS gain FROM m JOIN tf USING (term) GROUP BY ALL), s AS (SELECT query_id, doc_id, round(base + gain - ql * ln(dl + 2000e0), 6) AS score FROM h JOIN w USING (query_id) JOIN l USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def _(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.scoring_terms(F.col("text")))).alias("term"))
    return recall.dirichlet(read(spark, d, "documents"), q, "doc_id", "text").select("query_id", "doc_id", "score", "rank")


@query("n1_rank_fusion", f"""WITH {MEM}, s AS (SELECT user_id AS query_id, memory_id, confidence, importance, -age_days AS recency FROM mem),
 r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, memory_id) - 1 AS a, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, memory_id) - 1 AS b, row_number() OVER (PARTITION BY query_id ORDER BY recency DESC, memory_id) - 1 AS c FROM s)
 SELECT query_id, memory_id, round(1.0e0 / (60 + a) + 0.5e0 / (60 + b) + 2.0e0 / (60 + c), 8) AS rrf FROM r""")
def _(spark, d):
    rows = memories(spark, d).select(F.col("user_id").alias("query_id"), "memory_id", "confidence", "importance", (-F.col("age_days")).alias("recency"))
    return recall.fused(rows, "memory_id", {"confidence": 1.0, "importance": 0.5, "recency": 2.0})


@query("n8_topic_cap", f"WITH {MEM}, r AS (SELECT memory_id, row_number() OVER (PARTITION BY scope, substring(content, 1, 10) ORDER BY confidence DESC, memory_id) AS k FROM mem) SELECT memory_id FROM r WHERE k <= 3")
def _(spark, d):
    return recall.topic_cap(memories(spark, d).withColumn("score", F.col("confidence")), "memory_id").select("memory_id")


# decay and evidence


@query("m1_base_activation", f"""WITH {MEM}, e AS (SELECT memory_id, greatest(age_days * 86400e0, 1e0) AS c, greatest(access_age_days * 86400e0, 1e0) AS l, least(greatest(recall_count, 1), 20) AS n FROM mem),
 s AS (SELECT memory_id, list_sum(list_transform(range(0, n), lambda i: pow(greatest(c - (CASE WHEN n > 1 THEN i / (n - 1) ELSE 1e0 END) * (c - l), 1e0), -0.5e0))) AS s FROM e) SELECT memory_id, round(1 / (1 + exp(-ln(s) - 1)), 6) AS activation FROM s""")
def _(spark, d):
    return memories(spark, d).select("memory_id", F.round(S.base_activation(F.col("recall_count"), F.col("age_days"), F.col("access_age_days")), 6).alias("activation"))


@query("m3_weibull_fsrs", f"""WITH {MEM} SELECT memory_id, round({EFFECTIVE}, 6) AS lambda, round({_weibull('scope', 'age_days', EFFECTIVE)}, 6) AS survival,
 round(CASE WHEN age_days <= 0 THEN 1e0 ELSE 1 / (1 + age_days / (9 * (1e0 + recall_count))) END, 6) AS retrievability, round(greatest(0e0, least(1e0, 1 - (1 - pow(2e0, -age_days / 90e0)) / (1 + 0.5e0 * recall_count))), 6) AS retention, round(greatest(0.3e0, exp(-age_days / 90)), 6) AS gravity, {TIER} AS tier_weight FROM mem""")
def _(spark, d):
    scope, age, uses = F.col("scope"), F.col("age_days"), F.col("recall_count")
    lam = S.effective_lambda(scope, uses, F.col("emotion_intensity"))
    return memories(spark, d).select("memory_id", F.round(lam, 6).alias("lambda"), F.round(S.weibull(scope, age, lam), 6).alias("survival"), F.round(S.fsrs_retrievability(age, 1.0 + uses), 6).alias("retrievability"), F.round(S.adaptive_retention(age, uses), 6).alias("retention"), F.round(S.temporal_gravity(age), 6).alias("gravity"), S.tier_weight(F.col("access_age_days"), uses).alias("tier_weight"))


@query("m8_evidence", f"""WITH {MEM}, e AS (SELECT memory_id, bayes_alpha AS a, bayes_beta AS b, bayes_alpha / (bayes_alpha + bayes_beta) AS m, bayes_alpha * bayes_beta / ((bayes_alpha + bayes_beta) * (bayes_alpha + bayes_beta) * (bayes_alpha + bayes_beta + 1)) AS v, bayes_alpha + bayes_beta - 2 AS n FROM mem)
 SELECT memory_id, round(m, 6) AS mean, round(v, 6) AS variance, CASE WHEN m >= 0.85 AND v < 0.02 THEN 'verified' WHEN m >= 0.6 THEN 'probable' WHEN m >= 0.4 THEN 'uncertain' ELSE 'dubious' END AS tier,
 round(greatest(0.3e0, least(1.3e0, 0.5e0 + 0.5e0 * m + CASE WHEN v > 0.03 AND m > 0.3 THEN 0.1e0 ELSE 0e0 END)), 6) AS modifier,
 round(CASE WHEN n <= 0 THEN 0e0 ELSE ((a - 1) / n + 1.96e0 * 1.96e0 / (2 * n) - 1.96e0 * sqrt(((a - 1) / n * (1 - (a - 1) / n) + 1.96e0 * 1.96e0 / (4 * n)) / n)) / (1 + 1.96e0 * 1.96e0 / n) END, 6) AS wilson FROM e""")
def _(spark, d):
    a, b = F.col("bayes_alpha"), F.col("bayes_beta")
    return memories(spark, d).select("memory_id", F.round(S.beta_mean(a, b), 6).alias("mean"), F.round(S.beta_variance(a, b), 6).alias("variance"), S.confidence_tier(a, b).alias("tier"), F.round(S.recall_modifier(a, b), 6).alias("modifier"), F.round(S.wilson_lower(a, b), 6).alias("wilson"))


# facts

VERSIONS = f"{FACTS}, c AS (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY ts, fact_id) AS before FROM facts)"


@query("n4_fact_timeline", f"WITH {VERSIONS} SELECT fact_id, subject, predicate, object, ts AS valid_from, lead(ts) OVER w AS valid_until, row_number() OVER w AS version FROM c WHERE before IS NULL OR before <> object WINDOW w AS (PARTITION BY subject, predicate ORDER BY ts, fact_id)")
def _(spark, d):
    return facts.timeline(_facts(spark, d))


@query("j6_fact_conflicts", f"WITH {FACTS} SELECT subject, predicate, count(DISTINCT object) AS n_objects, last(object ORDER BY ts, fact_id) AS newest FROM facts GROUP BY ALL HAVING count(DISTINCT object) > 1")
def _(spark, d):
    return facts.conflicts(_facts(spark, d))


@query("n9_newest_facts", f"WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ts DESC, fact_id DESC) AS rank FROM facts) SELECT fact_id, subject, predicate, object, rank FROM r WHERE rank <= 2")
def _(spark, d):
    return facts.newest(_facts(spark, d))


# graph


@query("g2_k_hop", f"""WITH {EDGES}, b AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges)), h0 AS (SELECT 'c1' AS node UNION SELECT 'c2'), h1 AS (SELECT DISTINCT target AS node FROM h0 JOIN b ON node = source), h2 AS (SELECT DISTINCT target AS node FROM h1 JOIN b ON node = source),
 u AS (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(hop) AS hop FROM u GROUP BY node""")
def _(spark, d):
    return graph.k_hop(_edges(spark, d), _seeds(spark), 2)


# behaviour


@query("a23_drift", f"""WITH c AS (SELECT user_id, event_type, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS s, count(*) AS l FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY ALL),
 t AS (SELECT *, sum(s) OVER (PARTITION BY user_id) AS ns, sum(l) OVER (PARTITION BY user_id) AS nl FROM c), p AS (SELECT user_id, s / ns AS p, l / nl AS q FROM t WHERE ns >= 10 AND nl >= 20)
 SELECT user_id, round(greatest(0e0, least(1e0, sum(CASE WHEN p > 0 THEN 0.5e0 * p * log2(p / ((p + q) / 2)) ELSE 0e0 END + 0.5e0 * q * log2(q / ((p + q) / 2))))), 6) AS jsd FROM p GROUP BY user_id""")
def _(spark, d):
    return behavior.drift(read(spark, d, "events"), NOW)


@query("a21_absence", f"""SELECT user_id, event_type, earlier, round(earlier / 6, 6) AS per_week FROM (SELECT user_id, event_type, count(*) FILTER (date_diff('day', ts, TIMESTAMP '{NOW}') < 14) AS recent, count(*) FILTER (date_diff('day', ts, TIMESTAMP '{NOW}') BETWEEN 14 AND 55) AS earlier FROM events GROUP BY ALL) WHERE recent = 0 AND earlier >= 3""")
def _(spark, d):
    return behavior.absences(read(spark, d, "events"), NOW)


@query("z2_sessions", f"""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS ({BY_USER})), s AS (SELECT *, sum(n) OVER ({BY_USER}) AS session FROM g)
 SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY user_id, session""")
def _(spark, d):
    return behavior.sessions(read(spark, d, "events"))


@query("a36_transitions", f"""WITH s AS (SELECT event_type AS f, lead(event_type) OVER ({BY_USER}) AS t FROM events), c AS (SELECT f, t, count(*) AS n FROM s WHERE t IS NOT NULL AND f <> t GROUP BY ALL)
 SELECT f AS "from", t AS "to", n, round(CASE WHEN n >= 3 THEN 1 + 0.5e0 * n / sum(n) OVER (PARTITION BY f) ELSE 1e0 END, 6) AS boost FROM c""")
def _(spark, d):
    return behavior.transitions(read(spark, d, "events"))


@query("a25_learning_curve", f"""WITH r AS (SELECT user_id, value, row_number() OVER ({BY_USER}) - 1 AS k FROM events WHERE value > 0), w AS (SELECT user_id, k // 5 AS w, avg(value) AS v, count(*) AS n FROM r GROUP BY ALL HAVING count(*) = 5)
 SELECT user_id, round(regr_slope(ln(v), ln(w + 1)), 6) AS slope, count(*) AS n_windows FROM w GROUP BY user_id HAVING count(*) >= 3""")
def _(spark, d):
    return behavior.learning_curve(read(spark, d, "events"))


@query("a28_ewma", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL), k AS (SELECT *, max(r) OVER (PARTITION BY user_id) AS n FROM r WHERE r <= 20)
 SELECT user_id, round(sum(value * CASE WHEN r = n THEN pow(0.85e0, n - 1) ELSE 0.15e0 * pow(0.85e0, r - 1) END), 6) AS ewma FROM k GROUP BY user_id""")
def _(spark, d):
    return behavior.exponential_average(read(spark, d, "events"))


@query("a22_cycles", """WITH c AS (SELECT user_id, event_type, isodow(ts) - 1 AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS total, max(n) AS peak, CAST(first(day ORDER BY n DESC, day) AS INT) AS peak_day FROM c GROUP BY ALL)
 SELECT *, round(least(0.9e0, (peak / total - 1e0 / 7) * 3), 6) AS confidence FROM p WHERE total >= 5 AND peak >= 3 AND peak > 2 * total / 7""")
def _(spark, d):
    return behavior.cycles(read(spark, d, "events"))


@query("a17_hours", "WITH c AS (SELECT user_id, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def _(spark, d):
    return behavior.hour_histogram(read(spark, d, "events"))


@query("a19_mood_trend", f"""WITH h AS (SELECT user_id, value, ntile(2) OVER ({BY_USER}) AS h FROM events WHERE value IS NOT NULL), m AS (SELECT user_id, round(avg(value) FILTER (h = 2) - avg(value) FILTER (h = 1), 6) AS delta FROM h GROUP BY user_id)
 SELECT *, CASE WHEN delta > 0.15 THEN 'rising' WHEN delta < -0.15 THEN 'falling' ELSE 'stable' END AS trend FROM m""")
def _(spark, d):
    return behavior.mood_trend(read(spark, d, "events"))


@query("a35_usage", "SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, round(sum(value), 4) AS value FROM events GROUP BY ROLLUP (CAST(ts AS DATE))")
def _(spark, d):
    return behavior.usage_rollup(read(spark, d, "events"))


@query("a14_domain_quality", "WITH a AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS quality, count(*) FILTER (value < 10) AS low FROM events GROUP BY ALL) SELECT *, round(100e0 * (low + 1) / (n + 2), 6) AS rate, n >= 5 AND round(100e0 * (low + 1) / (n + 2), 6) > 10 AS weak FROM a")
def _(spark, d):
    return behavior.domain_quality(read(spark, d, "events"))


@query("a24_entropy", "WITH c AS (SELECT user_id, least(7, CAST(floor(value * 8 / 400e0) AS BIGINT)) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id")
def _(spark, d):
    return behavior.style_entropy(read(spark, d, "events"))


@query("z7_contexts", f"WITH s AS (SELECT lag(event_type, 2) OVER w AS a, lag(event_type, 1) OVER w AS b, event_type AS c FROM events WINDOW w AS ({BY_USER})) SELECT a, b, c, count(*) AS n FROM s WHERE a IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def _(spark, d):
    return behavior.trigram_succession(read(spark, d, "events"))


# lifecycle


@query("l8_decay_states", f"""WITH {MEM} SELECT memory_id, scope, CASE WHEN scope IN ('correction', 'preference', 'consolidated') THEN 'protected' WHEN age_days > 180 THEN 'absorb' WHEN age_days >= 90 THEN 'gist' WHEN age_days >= 30 THEN 'fade' ELSE 'fresh' END AS state,
 CASE WHEN access_age_days <= 1 THEN 'short_term' WHEN access_age_days <= 30 THEN 'mid_term' ELSE 'long_term' END AS tier FROM mem""")
def _(spark, d):
    return lifecycle.decay_states(memories(spark, d))


@query("l9_forget", f"""WITH {MEM}, r AS (SELECT memory_id, least(1e0, 0.3e0 * importance / 10 + 0.7e0 * {_weibull('scope', 'age_days', EFFECTIVE)}) AS r, bayes_alpha / (bayes_alpha + bayes_beta) AS c, greatest(0.05e0, least(0.3e0, 0.1e0 + 0.5e0 * (0.5e0 - 0.3e0))) AS t FROM mem)
 SELECT memory_id, round(r, 6) AS relevance, round(c, 6) AS truthfulness, CASE WHEN r >= t AND c >= 0.3 THEN 'keep' WHEN r >= t THEN 'verify' WHEN c >= 0.3 THEN 'demote' ELSE 'graveyard' END AS action FROM r""")
def _(spark, d):
    return lifecycle.forget_decisions(memories(spark, d))


@query("n2_evict", f"""WITH {MEM}, s AS (SELECT memory_id, scope, confidence * (1 + recall_count) / (1 + age_days / 30) AS score FROM mem), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, memory_id) AS k FROM s)
 SELECT memory_id, scope FROM r WHERE score < 0.3e0 * (SELECT list_sort(list(score))[1 + count(*) // 2] FROM s) AND k > 2""")
def _(spark, d):
    return lifecycle.evict(memories(spark, d))


@query("a32_audit", f"WITH {MEM} SELECT count(*) AS total, count(*) FILTER (length(content) < 50) AS short, count(*) FILTER (confidence < 0.6) AS low_confidence, count(*) FILTER (recall_count = 0 AND age_days > 90) AS zombie, count(*) FILTER (access_age_days > 60) AS stale FROM mem")
def _(spark, d):
    return lifecycle.audit(memories(spark, d))


@query("j4_similar_turns", f"""WITH t AS (SELECT conv_id * 100 + turn AS id, {CLEAN.format('text')} AS t FROM conversations UNION ALL SELECT -conv_id * 100 - turn - 1, {CLEAN.format("text || ' that is all'")} FROM conversations WHERE conv_id % 10 = 0), g AS (SELECT id, list_sort({GRAMS.format('t')}) AS g FROM t WHERE length(t) >= 3), c AS (SELECT g, min(id) AS id FROM g GROUP BY g),
 p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS n FROM c a JOIN c b ON a.id < b.id AND 10 * least(len(a.g), len(b.g)) >= 7 * greatest(len(a.g), len(b.g))) SELECT a, b, round(k / (n - k), 6) AS similarity FROM p WHERE round(k / (n - k), 6) >= 0.7""")
def _(spark, d):
    """The turns and edited copies of some, as few turns resemble each other on their own."""
    turns = read(spark, d, "conversations")
    rows = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("memory_id"), F.col("text").alias("content"))
    edited = turns.where("conv_id % 10 = 0").select((-F.col("conv_id") * 100 - F.col("turn") - 1).alias("memory_id"), F.concat("text", F.lit(" that is all")).alias("content"))
    return lifecycle.similar_pairs(rows.unionAll(edited))


# relational surface


@query("a12_scope_histogram", f"WITH {MEM} SELECT scope, count(*) AS n, round(avg(confidence), 6) AS confidence FROM mem GROUP BY scope")
def _(spark, d):
    return memories(spark, d).groupBy("scope").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("u2_recent_or_important", f"WITH {MEM} (SELECT memory_id FROM mem ORDER BY age_days, memory_id LIMIT 100) UNION (SELECT memory_id FROM mem WHERE emotion = 'important' ORDER BY age_days, memory_id LIMIT 50)")
def _(spark, d):
    m = memories(spark, d)
    return m.orderBy("age_days", "memory_id").limit(100).select("memory_id").unionAll(m.where("emotion = 'important'").orderBy("age_days", "memory_id").limit(50).select("memory_id")).distinct()


@query("q1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
