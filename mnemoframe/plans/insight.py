"""Queries of rollups, windows and choices with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import scores as S
from mnemoframe.functions import signals as G
from mnemoframe.operators import insight, stats
from mnemoframe.plans.catalog import FACTS, LATIN, MEM, NOW, _facts, query
from mnemoframe.plans.signals import has
from mnemoframe.sources.tables import memories, read

TS_NOW = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@query("a4_activation_mass", f"WITH {MEM}, t AS (SELECT 1 / (1 + age_days / 30) AS a, unnest(list_distinct({LATIN.format('content')})) AS term FROM mem) SELECT term, round(sum(a), 6) AS awdf FROM t GROUP BY term")
def _(spark, d):
    return insight.activation_mass(memories(spark, d), 1 / (1 + F.col("age_days") / 30)).select("term", F.round("awdf", 6).alias("awdf"))


_PAIRS = f"""t AS (SELECT conv_id * 1000 + turn AS id, {LATIN.format('text')} AS t FROM conversations), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM t) GROUP BY term),
 p AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM t), q AS (SELECT DISTINCT id, least(t[i], t[i + k]) AS w1, greatest(t[i], t[i + k]) AS w2 FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k <= len(t) AND t[i] <> t[i + k]),
 c AS (SELECT w1, w2, least(50, count(*)) AS n FROM q GROUP BY w1, w2), total AS (SELECT count(*) AS total FROM conversations),
 pmi AS (SELECT w1, w2, n, greatest(0, log2(n * total / (a.df * b.df))) AS pmi, a.df AS d1, b.df AS d2, total FROM c JOIN df a ON a.term = w1 JOIN df b ON b.term = w2, total)"""


def _pmi(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return turns, stats.ppmi(turns, "id", "text")


@query("a9_graduation", f"""WITH {_PAIRS}, f AS (SELECT w, count(*) AS fan FROM (SELECT w1 AS w FROM pmi UNION ALL SELECT w2 FROM pmi) GROUP BY w)
 SELECT w1, w2, n, round(pmi, 6) AS pmi FROM pmi JOIN f a ON a.w = w1 JOIN f b ON b.w = w2 WHERE n >= 2 AND pmi > 3 AND d1 <= 0.3 * total AND d2 <= 0.3 * total AND NOT (a.fan > 50 AND b.fan > 50)""")
def _(spark, d):
    turns, pairs = _pmi(spark, d)
    return insight.graduated(pairs, stats.document_frequency(turns, "id", "text"), turns.agg(F.count("*").alias("total")), least_count=2).select("w1", "w2", "n", F.round("pmi", 6).alias("pmi"))


_DOMAINS = """dom AS (SELECT event_type || ':' || user_id % 10 AS domain, count(*) AS total, sum(value % 10) AS quality_sum, count(*) FILTER (value % 10 < 1) AS corrections,
 (epoch_us(TIMESTAMP '2024-01-31') - max(epoch_us(ts)) FILTER (value % 10 < 1)) / 86400e6 AS days_since FROM events GROUP BY 1)"""


def _domains(spark, d):
    q, bad = F.expr("value % 10"), F.expr("value % 10 < 1")
    return read(spark, d, "events").groupBy(F.concat_ws(":", "event_type", F.expr("user_id % 10")).alias("domain")).agg(F.count("*").alias("total"), F.sum(q).alias("quality_sum"), F.count(F.when(bad, 1)).alias("corrections"), ((F.unix_micros(now()) - F.max(F.when(bad, insight.micros("ts")))) / 86400e6).alias("days_since"))


@query("a15_knowledge_decay", f"""WITH {_DOMAINS}, a AS (SELECT *, (corrections + 1) / (total + 2) AS rate, coalesce(days_since, 999) AS days FROM dom), b AS (SELECT *, greatest(3, 30 * (1 - rate)) AS half FROM a)
 SELECT domain, round(greatest(0.1, least(0.95, (1 - 0.3e0 * exp(-days / half)) / (1 + exp(-0.8e0 * (quality_sum / total - 5))))), 6) AS confidence, round(half, 6) AS half_life, CASE WHEN total >= 5 AND days < 3 THEN 'degrading' WHEN total >= 5 AND days > 14 AND rate < 0.1 THEN 'improving' ELSE 'stable' END AS trend FROM b""")
def _(spark, d):
    return insight.knowledge_decay(_domains(spark, d))


@query("a16_weak_domains", f"WITH {_DOMAINS}, r AS (SELECT domain, round(100 * (corrections + 1) / (total + 2), 1) AS rate, round(quality_sum / total, 1) AS quality FROM dom WHERE total >= 5) SELECT * FROM r WHERE rate > 10 OR quality < 5")
def _(spark, d):
    return insight.weak_domains(_domains(spark, d))


@query("a18_mood_state", f"""WITH m AS (SELECT user_id, event_id, ts, (value % 200) / 100 - 1 AS mood FROM events), d AS (SELECT user_id, count(*) FILTER (m < -0.3) AS low FROM (SELECT user_id, CAST(ts AS DATE) AS day, avg(mood) AS m FROM m WHERE ts > {TS_NOW} - INTERVAL 3 DAY GROUP BY 1, 2) GROUP BY user_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM m)
 SELECT r.user_id, round(CASE WHEN count(*) FILTER (ts > {TS_NOW} - INTERVAL 24 HOUR) >= 2 THEN avg(mood) FILTER (ts > {TS_NOW} - INTERVAL 24 HOUR) END, 6) AS mean_24h, coalesce(any_value(low), 0) AS low_days, count(*) FILTER (k <= 50 AND mood > 0.3) AS positive, count(*) FILTER (k <= 50 AND mood < -0.3) AS negative, least(50, count(*)) AS total FROM r LEFT JOIN d ON d.user_id = r.user_id GROUP BY r.user_id""")
def _(spark, d):
    return insight.mood_state(read(spark, d, "events").select("user_id", "event_id", "ts", F.expr("(value % 200) / 100 - 1").alias("mood")), now())


@query("a20_effectiveness", f"WITH {MEM} SELECT scope, round(sum(recall_count) / sum(recall_count + memory_id % 4), 6) AS effectiveness FROM mem GROUP BY scope")
def _(spark, d):
    rows = memories(spark, d).withColumn("miss", F.col("memory_id") % 4)
    return rows.groupBy("scope").agg(F.round(F.sum("recall_count") / F.sum(F.col("recall_count") + F.col("miss")), 6).alias("effectiveness"))


@query("a27_learned_styles", """WITH o AS (SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS slot, event_type AS topic, CAST(user_id % 3 AS VARCHAR) AS mood, 'style' || event_id % 4 AS style, value % 10 >= 6 AS ok, ts, event_id FROM events),
 g AS (SELECT slot, topic, mood, arg_min(style, (NOT ok, ts, event_id)) AS style, count(*) FILTER (ok) AS hits, count(*) FILTER (NOT ok) AS misses FROM o GROUP BY 1, 2, 3) SELECT * FROM g WHERE hits + misses >= 3 AND hits >= 0.4e0 * (hits + misses)""")
def _(spark, d):
    slot = F.expr("case when hour(ts) < 6 then 'night' when hour(ts) < 12 then 'morning' when hour(ts) < 18 then 'afternoon' else 'evening' end")
    return insight.learned_styles(read(spark, d, "events").select(slot.alias("slot"), F.col("event_type").alias("topic"), F.expr("cast(user_id % 3 as string)").alias("mood"), F.expr("concat('style', event_id % 4)").alias("style"), F.expr("value % 10 >= 6").alias("satisfied"), "ts", "event_id"))


@query("a29_fact_summary", f"WITH {FACTS} SELECT subject, predicate, array_to_string(list_sort(list_distinct(list(object))), ', ') AS objects FROM facts GROUP BY subject, predicate")
def _(spark, d):
    return _facts(spark, d).groupBy("subject", "predicate").agg(F.array_join(F.sort_array(F.collect_set("object")), ", ").alias("objects"))


@query("a30_recall_impact", f"WITH {MEM} SELECT md5(content) AS digest, round(avg(importance), 6) AS quality, count(*) AS n FROM mem WHERE recall_count > 0 AND content IS NOT NULL GROUP BY content")
def _(spark, d):
    return memories(spark, d).where("recall_count > 0 and content is not null").groupBy(F.md5("content").alias("digest")).agg(F.round(F.avg("importance"), 6).alias("quality"), F.count("*").alias("n"))


@query("a31_insight_rules", f"""WITH {MEM}, r AS (SELECT * FROM mem WHERE age_days <= 7 AND scope NOT IN ('expired', 'insight')), s AS (SELECT scope, count(*) AS n FROM r GROUP BY scope ORDER BY n DESC, scope LIMIT 1)
 SELECT 'scope:' || scope AS rule, n FROM s WHERE n >= 5 UNION ALL SELECT 'painful', n FROM (SELECT count(*) AS n FROM r WHERE emotion = 'painful') WHERE n >= 3 UNION ALL SELECT 'correction', n FROM (SELECT count(*) AS n FROM r WHERE scope = 'correction') WHERE n >= 3""")
def _(spark, d):
    return insight.insight_rules(memories(spark, d))


@query("a33_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("a34_growth", f"""WITH e AS (SELECT user_id, value, value % 10 < 1 AS bad, ts > {TS_NOW} - INTERVAL 7 DAY AS a, ts > {TS_NOW} - INTERVAL 14 DAY AND ts <= {TS_NOW} - INTERVAL 7 DAY AS b FROM events),
 g AS (SELECT user_id, count(*) FILTER (a AND bad) / greatest(1, count(*) FILTER (a)) AS r, count(*) FILTER (b AND bad) / greatest(1, count(*) FILTER (b)) AS p, avg(value) FILTER (a) AS m, avg(value) FILTER (b) AS q FROM e GROUP BY user_id)
 SELECT user_id, round(100 * r, 1) AS rate, CASE WHEN r < p - 0.02 THEN 'up' WHEN r > p + 0.02 THEN 'down' ELSE 'stable' END AS trend, round(m, 2) AS mean, CASE WHEN m IS NOT NULL THEN CASE WHEN m > q + 0.03 THEN 'up' WHEN m < q - 0.03 THEN 'down' ELSE 'stable' END END AS quality_trend FROM g""")
def _(spark, d):
    return insight.growth(read(spark, d, "events").select("user_id", "ts", F.expr("value % 10 < 1").alias("corrected"), "value"), now())


_WINS = "w AS (SELECT event_id, user_id, ts, event_type AS winner, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS loser FROM events QUALIFY loser IS NOT NULL AND loser <> event_type)"


def _wins(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("winner"), F.lag("event_type").over(w).alias("loser")).where("loser is not null and loser <> winner")


@query("a37_wins", f"WITH {_WINS} SELECT winner, loser, count(*) AS n FROM w GROUP BY winner, loser HAVING count(*) >= 2")
def _(spark, d):
    return _wins(spark, d).groupBy("winner", "loser").agg(F.count("*").alias("n")).where("n >= 2")


@query("m18_strengths", f"""WITH RECURSIVE {_WINS}, o AS (SELECT user_id, winner, loser, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM w), items AS (SELECT DISTINCT user_id, unnest([winner, loser]) AS item FROM w),
 s AS (SELECT user_id, item, 1.0e0 AS v, 0 AS k FROM items UNION ALL SELECT s.user_id, s.item, CASE s.item WHEN o.winner THEN s.v * (1 + 0.1e0 * l.v / (s.v + l.v)) WHEN o.loser THEN s.v * (1 - 0.1e0 * (1 - s.v / (s.v + l.v))) ELSE s.v END, o.k
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1 JOIN s l ON l.user_id = s.user_id AND l.k = s.k AND l.item = CASE s.item WHEN o.winner THEN o.loser ELSE o.winner END)
 SELECT user_id, item, round(arg_max(v, k), 6) AS strength FROM s GROUP BY user_id, item""")
def _(spark, d):
    return insight.strengths(_wins(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "item", F.round("strength", 6).alias("strength"))


@query("a38_evaluation", "SELECT user_id, round(avg(value % 10), 4) AS quality, round(100 * count(*) FILTER (value % 10 < 1) / count(*), 4) AS correction_percent, round(100 * count(*) FILTER (event_type = 'purchase') / count(*), 4) AS hit_percent FROM events GROUP BY user_id")
def _(spark, d):
    share = lambda c: F.round(100 * F.count(F.when(F.expr(c), 1)) / F.count("*"), 4)
    return read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.expr("value % 10")), 4).alias("quality"), share("value % 10 < 1").alias("correction_percent"), share("event_type = 'purchase'").alias("hit_percent"))


@query("a39_interactions", """WITH s AS (SELECT user_id * 100 + day(ts) AS g, list_distinct(list(event_type)) AS i, avg(value) AS q FROM events GROUP BY 1), p AS (SELECT q, i, unnest(i) AS a FROM s), r AS (SELECT q, a, unnest(i) AS b FROM p)
 SELECT a, b, count(*) AS n, round(avg(q), 5) AS quality FROM r WHERE a < b GROUP BY a, b HAVING count(*) >= 3""")
def _(spark, d):
    rows = read(spark, d, "events").withColumn("g", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return insight.pair_quality(rows, "g", "event_type", "value").withColumn("quality", F.round("quality", 5))


@query("n3_dropoff", f"WITH {MEM}, t AS (SELECT scope, confidence * importance AS s FROM mem QUALIFY row_number() OVER (PARTITION BY scope ORDER BY s DESC, memory_id) <= 10) SELECT scope, round((max(s) - min(s)) / max(s), 6) AS dropoff, (max(s) - min(s)) / max(s) < 0.3 AS aggregation FROM t GROUP BY scope HAVING count(*) >= 5 AND max(s) > 0")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("s"), "memory_id"))
    top = memories(spark, d).withColumn("s", F.col("confidence") * F.col("importance")).withColumn("r", rank).where("r <= 10")
    drop = (F.max("s") - F.min("s")) / F.max("s")
    return top.groupBy("scope").agg(F.round(drop, 6).alias("dropoff"), (drop < 0.3).alias("aggregation"), F.count("*").alias("n"), F.max("s").alias("m")).where("n >= 5 and m > 0").select("scope", "dropoff", "aggregation")


@query("n5_memory_timeline", f"""WITH {MEM}, m AS (SELECT memory_id, age_days, 'now' AS kind FROM mem WHERE contains(lower(content), 'license') UNION ALL SELECT memory_id, age_days + unnest(range(1, CAST(1 + recall_count % 3 AS BIGINT))) * 5, 'history' FROM mem WHERE contains(lower(content), 'license')) SELECT * FROM m""")
def _(spark, d):
    hit = memories(spark, d).where(F.contains(F.lower("content"), F.lit("license")))
    past = hit.where("recall_count % 3 > 0").select("memory_id", F.explode(F.transform(F.sequence(F.lit(1), (F.col("recall_count") % 3).cast("int")), lambda k: F.col("age_days") + 5 * k)).alias("age_days"), F.lit("history").alias("kind"))
    return hit.select("memory_id", "age_days", F.lit("now").alias("kind")).unionAll(past).orderBy("age_days", "memory_id")


@query("n6_prediction", """WITH s AS (SELECT user_id, event_id, ts, list((value % 100) / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM events), t AS (SELECT *, list_avg(v) AS m FROM s WHERE len(v) >= 2)
 SELECT user_id, event_id, ts, round((0.5e0 * v[1] + 0.3e0 * v[2] + 0.2e0 * coalesce(v[3], 0)) / CASE WHEN len(v) = 2 THEN 0.8e0 ELSE 1 END, 6) AS predicted, round(greatest(0.1, least(0.9, 1 - 4 * list_avg(list_transform(v, lambda x: (x - m) * (x - m))))), 6) AS confidence FROM t""")
def _(spark, d):
    return insight.moving_prediction(read(spark, d, "events").select("user_id", "event_id", "ts", F.expr("(value % 100) / 100").alias("v")), "user_id", ["ts", "event_id"], "v")


@query("n7_frustration", f"""WITH RECURSIVE l AS (SELECT conv_id, turn, text, lower(text) AS m, length(text) AS n, coalesce(lag(length(text)) OVER w, 0) AS b, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 f AS (SELECT *, regexp_matches(text, '[?？]') AS asks, {has(G.NEGATIVE)} > 0 AS bad FROM l),
 s AS (SELECT conv_id, turn, k, greatest(-0.2e0, least(0.5e0, CASE WHEN b > 0 AND n < 0.5e0 * b THEN 0.2e0 ELSE 0 END + CASE WHEN asks AND k > 3 THEN 0.15e0 ELSE 0 END + CASE WHEN bad THEN 0.3e0 ELSE 0 END + least(0.15e0, 0.02e0 * k) - CASE WHEN n > 1.2e0 * b THEN 0.15e0 ELSE 0 END - CASE WHEN NOT asks AND NOT bad THEN 0.05e0 ELSE 0 END)) AS signal FROM f),
 r AS (SELECT conv_id, turn, k, signal, signal AS acc FROM s WHERE k = 1 UNION ALL SELECT s.conv_id, s.turn, s.k, s.signal, 0.7e0 * r.acc + s.signal FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
 SELECT conv_id, turn, round(signal, 6) AS signal, round(greatest(0, least(1, acc)), 6) AS level FROM r""")
def _(spark, d):
    return insight.frustration(read(spark, d, "conversations"), "conv_id", "turn", G.any_of(F.lower("text"), G.NEGATIVE))


@query("n10_response_delay", """WITH RECURSIVE g AS (SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT user_id, event_id, k, 0.0e0 AS s FROM g WHERE k = 1 UNION ALL SELECT g.user_id, g.event_id, g.k, CASE WHEN gap < 3600 THEN 0.9e0 * s + 0.1e0 * gap ELSE s END FROM r JOIN g ON g.user_id = r.user_id AND g.k = r.k + 1) SELECT user_id, event_id, round(s, 4) AS delay FROM r""")
def _(spark, d):
    return insight.response_delay(read(spark, d, "events"))


@query("n11_time_travel", f"WITH {MEM}, h AS (SELECT user_id, memory_id, age_days, importance, row_number() OVER w AS place, first_value(memory_id) OVER w AS first_id, first_value(importance) OVER w AS first_importance FROM mem WHERE scope <> 'expired' AND content ILIKE '%license%' WINDOW w AS (PARTITION BY user_id ORDER BY age_days DESC, memory_id)) SELECT user_id, memory_id, place, first_id, importance - first_importance AS change FROM h")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("age_days"), "memory_id")
    hit = memories(spark, d).where("scope <> 'expired'").where(F.col("content").ilike("%license%"))
    return hit.select("user_id", "memory_id", F.row_number().over(w).alias("place"), F.first("memory_id").over(w).alias("first_id"), (F.col("importance") - F.first("importance").over(w)).alias("change"))


@query("j8_contradictions", f"""WITH {MEM}, r AS (SELECT scope, memory_id, content, row_number() OVER (PARTITION BY scope ORDER BY age_days, memory_id) AS k FROM mem)
 SELECT a.memory_id AS newer, b.memory_id AS older FROM r a JOIN r b ON a.scope = b.scope AND a.k <= 10 AND b.k BETWEEN 11 AND 20 WHERE (contains(a.content, 'the') AND contains(b.content, 'la')) OR (contains(a.content, 'la') AND contains(b.content, 'the'))""")
def _(spark, d):
    """The tables hold no contradictory CJK phrases, so two words stand for the two poles here."""
    pole = lambda c, w: F.contains(c, F.lit(w))
    return insight.contradictions(memories(spark, d), lambda a, b: (pole(a, "the") & pole(b, "la")) | (pole(a, "la") & pole(b, "the")))


@query("j11_co_written", "WITH t AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND value % 10 < 2) SELECT DISTINCT e.event_id FROM events e JOIN t ON abs(epoch_us(e.ts) - epoch_us(t.ts)) < 5000000 AND e.event_id <> t.event_id")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return insight.co_written(e, e.where("event_type = 'purchase' and value % 10 < 2"))


@query("j12_segment_counts", f"WITH {MEM} SELECT memory_id, count(*) OVER (PARTITION BY user_id, channel_id) AS n, round(1 + least(0.15, 0.05e0 * (count(*) OVER (PARTITION BY user_id, channel_id) - 1)), 6) AS boost FROM mem")
def _(spark, d):
    n = F.count("*").over(Window.partitionBy("user_id", "channel_id"))
    return memories(spark, d).select("memory_id", n.alias("n"), F.round(1 + F.least(F.lit(0.15), 0.05 * (n - 1)), 6).alias("boost"))


@query("j13_say_do", "WITH i AS (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'signup' OR value % 10 < 1 GROUP BY user_id) SELECT e.user_id, count(*) AS n, count(*) FILTER (hour(ts) < 5) AS late FROM events e JOIN i ON i.user_id = e.user_id AND e.ts > i.s GROUP BY e.user_id HAVING count(*) > 5 AND count(*) FILTER (hour(ts) < 5) > 0.2 * count(*)")
def _(spark, d):
    e = read(spark, d, "events")
    return insight.say_do_gap(e.where("event_type = 'signup' or value % 10 < 1"), e, share=0.2)


@query("o8_trim_history", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations) SELECT conv_id, turn, 'extreme' AS tier FROM r WHERE d < 3 OR u = 1 UNION ALL SELECT conv_id, turn, 'light' FROM r WHERE d <= 3")
def _(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn")
    return insight.trimmed_history(t, "conv_id", "turn", 3, True).withColumn("tier", F.lit("extreme")).unionAll(insight.trimmed_history(t, "conv_id", "turn", 3, False).withColumn("tier", F.lit("light")))


@query("o10_recommended", f"WITH {MEM}, a AS (SELECT memory_id, importance, 1 / (1 + age_days / 45) AS r FROM mem WHERE scope NOT IN ('expired', 'decayed', 'consolidated') AND importance >= 6), b AS (SELECT memory_id, round((0.6e0 - r) / 0.3e0, 6) AS urgency, importance FROM a WHERE r BETWEEN 0.3 AND 0.6) SELECT * FROM b QUALIFY row_number() OVER (ORDER BY urgency * importance DESC, memory_id) <= 3")
def _(spark, d):
    return insight.recommended(memories(spark, d), stability=5)


@query("o11_sample", "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) <= 30")
def _(spark, d):
    return insight.sampled(read(spark, d, "documents").select("doc_id"), "doc_id", 30, 7)


@query("o12_promotions", f"""WITH {MEM}, a AS (SELECT *, recall_count AS e, memory_id % 4 AS m, CAST(memory_id % 30 AS DOUBLE) AS stability FROM mem)
 SELECT memory_id, round(0.4e0 * CASE WHEN e / greatest(1, e + m) > 0.6 AND e >= 5 THEN 1 ELSE 0 END + 0.3e0 * least(1, CASE WHEN emotion IN ('important', 'warm') THEN 0.5e0 ELSE 0 END + CASE WHEN recall_count >= 3 THEN 0.5e0 ELSE 0 END + CASE WHEN scope IN ('preference', 'fact') THEN 0.3e0 ELSE 0 END)
  + 0.3e0 * CASE WHEN recall_count / greatest(1, age_days) > 0.5 AND stability > 10 THEN 1 ELSE 0 END, 6) AS score FROM a WHERE scope NOT IN ('expired', 'decayed', 'core_memory') AND score > 0.5""")
def _(spark, d):
    rows = memories(spark, d).withColumn("engaged_count", F.col("recall_count")).withColumn("miss_count", F.col("memory_id") % 4).withColumn("stability", (F.col("memory_id") % 30).cast("double"))
    return insight.promotions(rows)


@query("u3_difference", f"WITH {MEM} SELECT memory_id FROM mem WHERE importance >= 6 AND memory_id NOT IN (SELECT memory_id FROM mem WHERE recall_count > 2)")
def _(spark, d):
    m = memories(spark, d)
    return m.where("importance >= 6").select("memory_id").join(m.where("recall_count > 2").select("memory_id"), "memory_id", "left_anti")


@query("l19_pair_decay", f"WITH {_PAIRS} SELECT w1, w2, round(n * CASE WHEN n > 10 THEN 0.995e0 ELSE 0.98e0 END, 6) AS n FROM c")
def _(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return insight.decayed_pairs(stats.cooccurrence(turns, "id", "text")).select("w1", "w2", F.round("n", 6).alias("n"))


_Q = ["licensed", "under", "the", "apache", "license"]


@query("r3_phrase_score", "SELECT doc_id, round((" + " + ".join(f"CAST(contains(lower(text), '{a} {b}') OR contains(lower(text), '{a}{b}') AS INT)" for a, b in zip(_Q, _Q[1:])) + " + " + " + ".join(f"2 * CAST(contains(lower(text), '{a} {b} {c}') AS INT)" for a, b, c in zip(_Q, _Q[1:], _Q[2:])) + ") / 7e0, 6) AS score FROM documents WHERE score > 0")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(insight.phrase_score(_Q, F.col("text")), 6).alias("score")).where("score > 0")


@query("m7_decay_forms", f"""WITH {MEM} SELECT memory_id, round(1 - (1 - pow(2, -age_days / 30)) / (1 + 0.5e0 * recall_count), 6) AS adaptive, round((bayes_alpha + 0.3e0 + 0.7e0 * 0.5) / (bayes_alpha + 0.65e0 + bayes_beta), 6) AS after_positive, round(bayes_alpha / (bayes_alpha + bayes_beta + 1.25e0), 6) AS after_negative,
 round(bayes_alpha / (bayes_alpha + bayes_beta + CASE WHEN access_age_days > 1 THEN least(0.1, 0.02e0 * log2(access_age_days)) ELSE 0 END), 6) AS after_time FROM mem""")
def _(spark, d):
    a, b, days = F.col("bayes_alpha"), F.col("bayes_beta"), F.col("access_age_days")
    up, down, idle = S.positive_evidence(a, b, F.lit(0.5)), S.negative_evidence(a, b, F.lit(0.5)), S.idle_evidence(a, b, days)
    mean = lambda ab: F.round(S.beta_mean(ab[0], ab[1]), 6)
    return memories(spark, d).select("memory_id", F.round(S.adaptive_retention(F.col("age_days"), F.col("recall_count"), 30.0), 6).alias("adaptive"), mean(up).alias("after_positive"), mean(down).alias("after_negative"), mean(idle).alias("after_time"))
