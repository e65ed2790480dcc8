"""Queries of chunkers, message signals, state replays and reranks; they join the registry of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import chunks as C
from mnemoframe.functions import dialogue as D
from mnemoframe.functions import scores as S
from mnemoframe.functions import text as T
from mnemoframe.operators import rerank
from mnemoframe.plans.catalog import MEM, query
from mnemoframe.sources.tables import memories, read

#: Pieces of oracle SQL.
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = "list_transform(regexp_extract_all({}, '[一-鿿]{{2,}}|[a-zA-Z]{{3,}}'), lambda x: lower(x))"


def _packed(name: str, source: str, joiner: str) -> str:
    """CTEs that pack the lists of ``source`` (id, k, parts) into ``name`` (id, k, i, chunk)."""
    trimmed = TRIM.format("done")
    return f"""{name}_r AS (SELECT id, k, parts, 1 AS i, '' AS held, CAST(NULL AS VARCHAR) AS done FROM {source}
 UNION ALL SELECT id, k, parts, i + 1, CASE WHEN held = '' OR length(held) + length(parts[i]) > 500 THEN parts[i] ELSE held || {joiner} || parts[i] END, CASE WHEN held <> '' AND length(held) + length(parts[i]) > 500 THEN held END FROM {name}_r WHERE i <= len(parts)),
 {name} AS (SELECT id, k, i, {trimmed} AS chunk FROM {name}_r WHERE done IS NOT NULL UNION ALL SELECT id, k, i + 1, {TRIM.format('held')} FROM {name}_r WHERE i = len(parts) + 1 AND {TRIM.format('held')} <> '')"""


BY_PARAGRAPH = rf"""p0 AS (SELECT id, 0 AS k, string_split_regex(t, '\n\n+') AS parts FROM src), {_packed('p1', 'p0', 'chr(10) || chr(10)')},
 p2 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, i) AS k, chunk FROM p1), s0 AS (SELECT id, k, string_split_regex(chunk, '[。！？.!?\n]+') AS parts FROM p2 WHERE length(chunk) > 500), {_packed('s1', 's0', "'。'")},
 c AS (SELECT id, k, 0 AS i, chunk FROM p2 WHERE length(chunk) <= 500 UNION ALL SELECT id, k, i, chunk FROM s1), chunked AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, i) - 1 AS chunk_no, chunk FROM c WHERE length(chunk) > 10)"""


@query("t18_paragraph_chunks", f"WITH RECURSIVE src AS (SELECT doc_id AS id, text AS t FROM documents), {BY_PARAGRAPH} SELECT id AS doc_id, chunk_no, chunk FROM chunked")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(C.by_paragraph(F.col("text"))).alias("chunk_no", "chunk"))


# every line is made a heading, so that the whole table has some
@query("t19_heading_sections", rf"""WITH RECURSIVE h AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || '## '), '(?m)^(##\s)', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents),
 src AS (SELECT doc_id * 100000 + k AS id, s[k] AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM h)), {BY_PARAGRAPH}, small AS (SELECT id, 0 AS chunk_no, {TRIM.format('t')} AS chunk FROM src WHERE length(t) <= 500),
 a AS (SELECT * FROM small WHERE length(chunk) > 10 UNION ALL SELECT c.* FROM chunked c JOIN src USING (id) WHERE length(t) > 500) SELECT id // 100000 AS doc_id, row_number() OVER (PARTITION BY id // 100000 ORDER BY id, chunk_no) - 1 AS chunk_no, chunk FROM a""")
def _(spark, d):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## "))
    return read(spark, d, "documents").select("doc_id", F.posexplode(C.by_heading(text)).alias("chunk_no", "chunk"))


@query("t23_dense_sentences", rf"""WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([。！？!?.\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: length({TRIM.format('x')}) > 3) AS s FROM documents WHERE text IS NOT NULL),
 e AS (SELECT doc_id, length(text) AS n, len(s) AS m, unnest(range(1, len(s) + 1)) AS i, s FROM s), w AS (SELECT doc_id, n, m, i, s[i] AS s, {WORDS.format('s[i]')} AS w, len(regexp_extract_all(s[i], '\d+|`[^`]+`|[A-Z][a-z]+[A-Z]|[A-Z]{{2,}}')) AS entities FROM e),
 d AS (SELECT *, (CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0e0 END) * (1 + least(entities * 0.2e0, 0.8e0)) * (CASE WHEN i IN (1, m) THEN 1.2e0 ELSE 1e0 END) * (CASE WHEN length(s) < 10 THEN 0.5e0 ELSE 1e0 END) AS density FROM w),
 r AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY density DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
 k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS kept FROM r WHERE before < ceil(n * 0.4e0) GROUP BY doc_id) SELECT doc_id, CASE WHEN len(s) <= 2 THEN text ELSE kept END AS digest FROM s LEFT JOIN k USING (doc_id)""")
def _(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", C.dense_sentences(F.col("text")).alias("digest"))


# messages

TURNS = "t AS (SELECT *, (turn * 37 + conv_id * 11) % 150 * 1000 AS delay, regexp_extract(text, '[a-zA-Z]{3,}') AS topic FROM conversations), u AS (SELECT *, coalesce(lag(topic) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM t)"


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, d, "conversations").withColumn("delay", (F.col("turn") * 37 + F.col("conv_id") * 11) % 150 * 1000).withColumn("topic", F.regexp_extract("text", "[a-zA-Z]{3,}", 0))
    return t.withColumn("previous", F.coalesce(F.lag("topic").over(w), F.lit(""))).withColumn("question", F.lag("text").over(w))


@query("x7_reply_quality", rf"""WITH {TURNS}, q AS (SELECT conv_id, turn, greatest(0e0, least(1e0, 0.5e0 + (CASE WHEN length(text) > 50 THEN 0.12e0 WHEN length(text) > 15 THEN 0.05e0 WHEN length(text) < 5 THEN -0.1e0 ELSE 0e0 END) + (CASE WHEN delay < 5000 THEN 0.1e0 WHEN delay > 120000 THEN -0.15e0 ELSE 0e0 END)
 + (CASE WHEN regexp_matches(text, '[？?]|怎么|为什么|能不能|具体|详细') THEN 0.12e0 ELSE 0e0 END) - (CASE WHEN regexp_matches({TRIM.format('text')}, '(?i)^(嗯|好的?|ok|谢谢|收到|明白|了解)\s*[。.!！]?\s*$') THEN 0.05e0 ELSE 0e0 END)
 - (CASE WHEN previous <> '' AND topic <> '' AND previous <> topic THEN 0.08e0 ELSE 0e0 END))) AS q FROM u) SELECT conv_id, turn, round(q, 6) AS quality, CASE WHEN round(q, 6) > 0.6 THEN 'positive' WHEN round(q, 6) < 0.35 THEN 'negative' ELSE 'neutral' END AS signal FROM q""")
def _(spark, d):
    t = _turns(spark, d).withColumn("quality", F.round(D.reply_quality(F.col("text"), F.col("delay"), F.col("previous"), F.col("topic")), 6))
    return t.select("conv_id", "turn", "quality", D.signal_of(F.col("quality")).alias("signal"))


@query("t29_answer_score", rf"""WITH {TURNS}, w AS (SELECT *, list_distinct({WORDS.format('question')}) AS q, {WORDS.format('text')} AS a FROM u WHERE question IS NOT NULL),
 f AS (SELECT *, len(list_filter(a, lambda x: list_contains(q, x))) AS shared FROM w), g AS (SELECT conv_id, turn, -0.225e0 + 0.5e0 * (length(text) > 50)::INT + 0.5e0 * (length(text) > 200)::INT - (length(text) > 1000 AND length(question) < 30)::INT - 1.5e0 * (length(text) < 10 AND length(question) > 50)::INT
 + regexp_matches(text, '因为|所以|首先|其次|原因|本质上|because|therefore')::INT + 0.5e0 * contains(text, '```')::INT + 0.3e0 * regexp_matches(text, '(?m)^[-*•]\s|^\d+\.\s')::INT + 0.3e0 * regexp_matches(text, '不确定|不太确定|可能|I''m not sure')::INT - 1.5e0 * regexp_matches(text, '我不知道|无法回答|超出了我的')::INT
 + 1.5e0 * (CASE WHEN len(q) > 0 THEN least(1e0, shared / len(q)) ELSE 0 END) - 2e0 * regexp_matches(text, '(?i)作为一个?AI|作为人工智能|作为语言模型|I am an AI')::INT + 0.5e0 * (len(q) > 0 AND len(a) - shared > 2 * len(q))::INT AS z FROM f)
 SELECT conv_id, turn, round(9 / (1 + exp(-z)) + 1, 1) AS score FROM g""")
def _(spark, d):
    return _turns(spark, d).where("question is not null").select("conv_id", "turn", D.answer_score(F.col("question"), F.col("text")).alias("score"))


@query("t13_reasoning", rf"""SELECT doc_id, regexp_extract(text, '(?i)(?:based on|because)\s+(.{{3,80}})(?:therefore|so|thus)\s+(.{{3,120}})', 1) AS context, 0.7e0 AS confidence FROM documents WHERE regexp_matches(text, '(?i)(?:based on|because)\s+(.{{3,80}})(?:therefore|so|thus)\s+(.{{3,120}})')
 UNION ALL SELECT doc_id, {TRIM.format(r"regexp_extract(text, '(.{3,80})\s*[=\-]>\s*(.{3,120})', 1)")}, 0.6e0 FROM documents WHERE regexp_matches(text, '(.{{3,80}})\s*[=\-]>\s*(.{{3,120}})') AND NOT regexp_matches(text, '(?i)(?:based on|because)\s+(.{{3,80}})(?:therefore|so|thus)\s+(.{{3,120}})')""")
def _(spark, d):
    r = D.reasoning(F.col("text"))
    return read(spark, d, "documents").select("doc_id", r.alias("r")).where("r is not null").select("doc_id", "r.context", "r.confidence")


@query("m14_circadian", "WITH h AS (SELECT event_id, hour(ts) + minute(ts) / 60 AS h FROM events) SELECT event_id, round(0.2e0 * (0.7e0 * cos((h - 10) / 24 * 2 * pi()) + 0.3e0 * cos((h - 10) / 12 * 2 * pi())) - 0.05e0 - CASE WHEN h < 5 THEN 0.15e0 * (1 - abs(h - 2.5e0) / 2.5e0) ELSE 0 END, 6) AS energy FROM h")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.round(D.circadian_energy(F.hour("ts") + F.minute("ts") / 60), 6).alias("energy"))


STRESS = f"""WITH {TURNS}, s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS fore, greatest(-0.3e0, least(0.5e0,
 (CASE WHEN length(text) < 10 THEN 0.15e0 WHEN length(text) > 80 THEN -0.1e0 ELSE 0e0 END) + (CASE WHEN regexp_matches(text, '{D.STRAIN}') THEN 0.25e0 ELSE 0e0 END) - (CASE WHEN regexp_matches(text, '{D.RELIEF}') THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN regexp_matches(text, '[！!]{{2,}}|[？?]{{2,}}') THEN 0.1e0 ELSE 0e0 END)
 + (CASE WHEN delay < 10000 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > greatest(1, count(*) OVER (PARTITION BY conv_id) - 14) THEN 0.1e0 ELSE 0e0 END))) AS f FROM u),
 l AS (SELECT conv_id, list_reduce(list_prepend([0e0, 0e0], list([f, 0e0] ORDER BY turn)), lambda a, b: [greatest(0e0, least(1e0, a[1] + a[2] - 0.15e0 * a[1] + b[1] - 0.3e0 * a[2])), greatest(-0.5e0, least(0.5e0, a[2] - 0.15e0 * a[1] + b[1] - 0.3e0 * a[2]))]) AS z FROM s WHERE n >= 5 AND back <= 15 GROUP BY conv_id),
 r AS (SELECT conv_id, round(z[1], 6) AS level, round(z[2], 6) AS velocity FROM l) SELECT *, CASE WHEN level > 0.6 AND velocity > 0 THEN 'peak' WHEN level > 0.3 AND velocity > 0.05 THEN 'accumulating' WHEN level > 0.3 AND velocity < -0.05 THEN 'releasing' ELSE 'calm' END AS phase FROM r"""


@query("m20_stress", STRESS)
def _(spark, d):
    """The last 15 messages of conversations of five or more."""
    w = Window.partitionBy("conv_id")
    t = _turns(spark, d).withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("n", F.count("*").over(w)).where("n >= 5 and back <= 15")
    first = F.row_number().over(w.orderBy("turn")) == 1
    s = t.withColumn("f", D.stress_signal(F.col("text"), F.when(~first, F.col("delay"))))
    r = s.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "f"))).alias("s")).select("conv_id", D.stress_replay(F.transform("s", lambda x: x["f"])).alias("z"))
    r = r.select("conv_id", F.round("z.x", 6).alias("level"), F.round("z.v", 6).alias("velocity"))
    return r.withColumn("phase", D.stress_phase(F.col("level"), F.col("velocity")))


@query("m21_belief", "WITH l AS (SELECT user_id, event_type, list([(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END), 0e0] ORDER BY ts, event_id) AS l FROM events GROUP BY ALL) SELECT user_id, event_type, round(list_reduce(list_prepend([0.5e0, 0e0], l), lambda a, b: [CASE WHEN b[1] = 1 THEN a[1] + (1 - a[1]) * 0.2e0 ELSE a[1] * 0.6e0 END, 0e0])[1], 6) AS belief FROM l")
def _(spark, d):
    g = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 50).alias("yes")))).alias("l"))
    return g.select("user_id", "event_type", F.round(D.belief(F.transform("l", lambda x: x["yes"])), 6).alias("belief"))


@query("z17_relationship", """WITH l AS (SELECT user_id, list([CASE event_type WHEN 'error' THEN 1e0 WHEN 'purchase' THEN 2e0 WHEN 'signup' THEN 3e0 ELSE 0e0 END, 0e0] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
 r AS (SELECT user_id, list_reduce(list_prepend([0.5e0, 0e0], l), lambda a, b: [CASE b[1] WHEN 1 THEN greatest(0e0, a[1] - 0.03e0) WHEN 2 THEN least(1e0, a[1] + 0.02e0) ELSE a[1] END, CASE b[1] WHEN 2 THEN least(1e0, a[2] + 0.01e0) WHEN 3 THEN least(1e0, a[2] + 0.005e0) ELSE a[2] END]) AS z FROM l) SELECT user_id, round(z[1], 6) AS trust, round(z[2], 6) AS familiarity FROM r""")
def _(spark, d):
    kind = F.create_map(*[F.lit(x) for p in (("error", "correction"), ("purchase", "positive"), ("signup", "session_end")) for x in p])[F.col("event_type")]
    g = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.coalesce(kind, F.lit("")).alias("kind")))).alias("l"))
    return g.select("user_id", D.relationship(F.transform("l", lambda x: x["kind"])).alias("z")).select("user_id", F.round("z.trust", 6).alias("trust"), F.round("z.familiarity", 6).alias("familiarity"))


# reranks


def _candidates(spark, d):
    """A conversation's turns as the candidates of one query, scored by a rule."""
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("memory_id"), F.col("text").alias("content"), F.when(F.col("turn") % 4 == 0, "fact").otherwise("event").alias("scope"), ((F.col("turn") + 1) * 3600000).alias("age_ms"), (1 / (1 + (F.col("turn") * 5 + F.col("conv_id")) % 11)).alias("score"))


@query("o2_interference")
def _(spark, d):
    return rerank.interference(_candidates(spark, d), 6).withColumn("activation", F.round("activation", 6))


@query("o3_diversified")
def _(spark, d):
    return rerank.diversified(_candidates(spark, d), 5)


@query("o7_token_budget", r"""WITH s AS (SELECT conv_id, turn, round(sum(1.5e0 * len(regexp_extract_all(text, '[一-鿿]')) + 1.3e0 * len(regexp_extract_all(text, '[a-zA-Z]+')) + 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS used FROM conversations) SELECT * FROM s WHERE used <= 200""")
def _(spark, d):
    rows = read(spark, d, "conversations").withColumnRenamed("text", "content")
    return rerank.within_budget(rows, ["conv_id"], ["turn"], 200.0).select("conv_id", "turn", "used")


@query("l27_working_memory", "WITH a AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(event_id) DESC, user_id LIMIT 100), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events JOIN a USING (user_id)) SELECT user_id, event_id FROM r WHERE k <= 20")
def _(spark, d):
    return rerank.working_memory(read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("m5_fsrs_update", f"""WITH {MEM}, r AS (SELECT memory_id, recall_count % 4 + 1 AS rating, (bayes_beta - 1) / 10 + 0.1e0 AS difficulty, bayes_alpha AS s, CASE WHEN access_age_days <= 0 THEN 1e0 ELSE 1 / (1 + access_age_days / (9 * bayes_alpha)) END AS r FROM mem)
 SELECT memory_id, round(greatest(0.1e0, CASE WHEN rating >= 3 THEN s * (1 + exp(1.49e0) * (11 - difficulty * 10) * pow(s, -0.14e0) * (exp((1 - r) * 0.94e0) - 1)) ELSE s * pow(2.18e0, difficulty * 10 - 1) END), 5) AS stability, round(greatest(0e0, least(1e0, difficulty + CASE WHEN rating >= 3 THEN -0.02e0 * (rating - 2) ELSE 0.1e0 * (2 - rating) END)), 6) AS difficulty FROM r""")
def _(spark, d):
    m = memories(spark, d)
    difficulty, rating = (F.col("bayes_beta") - 1) / 10 + 0.1, F.col("recall_count") % 4 + 1
    stability, harder = S.fsrs_update(F.col("bayes_alpha"), difficulty, rating, F.col("access_age_days"))
    return m.select("memory_id", F.round(stability, 5).alias("stability"), F.round(harder, 6).alias("difficulty"))


@query("r6_emotion_resonance", f"""WITH {MEM}, g AS (SELECT *, sqrt(pow(0.5e0 - (importance / 10 - 0.5e0), 2) + pow(0.6e0 - confidence, 2)) AS far FROM mem)
 SELECT memory_id, round(least(1e0, 0.5e0 * greatest(0.2e0, 1 / (1 + exp(far * 3 - 1.5e0))) * (CASE WHEN emotion = 'warm' THEN 1.4e0 ELSE 1e0 END) * (1 + 0.5e0 * emotion_intensity)), 6) AS resonance FROM g""")
def _(spark, d):
    """Mood .5 and alertness .6 now; the mood and energy at writing come from importance and confidence."""
    return memories(spark, d).select("memory_id", F.round(S.emotion_resonance(F.col("emotion"), F.col("emotion_intensity"), F.col("importance") / 10 - 0.5, F.col("confidence"), 0.5, 0.6), 6).alias("resonance"))


@query("r9_temporal_range", "WITH t AS (SELECT event_id, epoch(ts) AS t, epoch(TIMESTAMP '2024-01-10') AS a, epoch(TIMESTAMP '2024-01-12') AS b FROM events) SELECT event_id, round(CASE WHEN t BETWEEN a AND b THEN 1e0 ELSE greatest(0e0, 1 - least(abs(t - a), abs(t - b)) / (b - a)) END, 6) AS temporal FROM t")
def _(spark, d):
    epoch = lambda c: F.unix_micros(c) / 1e6
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.round(S.range_closeness(epoch(F.col("ts")), epoch(F.to_timestamp(F.lit("2024-01-10"))), epoch(F.to_timestamp(F.lit("2024-01-12")))), 6).alias("temporal"))


@query("r31_episodes", f"""WITH q AS (SELECT item_id, list_distinct({WORDS.format('text')}) AS q FROM benchmark), e AS (SELECT conv_id, {WORDS.format('text')} AS w, role = 'system' AS corrected FROM conversations WHERE turn = 0),
 s AS (SELECT item_id, conv_id, len(list_filter(w, lambda x: list_contains(q, x))) * (CASE WHEN corrected THEN 1.5e0 ELSE 1e0 END) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) AS rank FROM s WHERE score > 0) SELECT item_id, conv_id, score, rank FROM r WHERE rank <= 2""")
def _(spark, d):
    """The first turn of a conversation is an episode's topic; a system turn counts as a correction."""
    q = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(C.words(F.col("text")))).alias("w"))
    e = read(spark, d, "conversations").where("turn = 0").select("conv_id", (F.col("role") == "system").alias("corrected"), F.explode(C.words(F.col("text"))).alias("w"))
    e = e.groupBy("conv_id", "corrected", "w").agg(F.count("*").alias("tf"))
    s = q.join(e, "w").groupBy("item_id", "conv_id", "corrected").agg(F.sum("tf").alias("n")).select("item_id", "conv_id", (F.col("n") * F.when(F.col("corrected"), 1.5).otherwise(1.0)).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "conv_id"))).where("rank <= 2")


@query("t2_word_counts", f"SELECT doc_id, len({WORDS.format('text')}) AS n_words, len(list_distinct({WORDS.format('text')})) AS n_distinct, ceil(1.5e0 * len(regexp_extract_all(text, '[一-鿿]')) + 0.25e0 * (length(text) - len(regexp_extract_all(text, '[一-鿿]'))))::BIGINT AS cost FROM documents")
def _(spark, d):
    w, cjk = C.words(F.col("text")), F.regexp_count("text", F.lit(T.CJK))
    return read(spark, d, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.ceil(1.5 * cjk + 0.25 * (F.length("text") - cjk)).alias("cost"))


ENGAGED = f"""0.5e0 + (CASE WHEN length(text) > greatest(1, length(question)) THEN 0.25e0 WHEN 2 * length(text) > greatest(1, length(question)) THEN 0.15e0 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[？?]') THEN 0.1e0 ELSE 0 END)
 + (CASE WHEN regexp_matches(text, '(?i){D.AGREEMENT}') THEN 0.15e0 ELSE 0 END) - (CASE WHEN regexp_matches(text, '(?i){D.DISSENT}') THEN 0.2e0 ELSE 0 END) - (CASE WHEN length(text) < 5 AND regexp_matches(text, '(?i){D.SHRUG}') THEN 0.15e0 ELSE 0 END)"""


@query("x8_engagement", f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN text = '' THEN 0e0 ELSE round(greatest(0e0, least(1e0, {ENGAGED})), 6) END AS engagement FROM u WHERE question IS NOT NULL")
def _(spark, d):
    return _turns(spark, d).where("question is not null").select("conv_id", "turn", F.round(D.engagement(F.col("text"), F.col("question")), 6).alias("engagement"))


TOKENS = "list_distinct(list_transform(regexp_extract_all(lower({}), '[a-z]{{2,}}|[0-9]{{2,}}'), lambda x: x))"
GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substring({0}, i, 3)))"


# the table holds no CJK text, so the oracle leaves that part out
@query("x8_affinity", rf"""WITH {TURNS}, p AS (SELECT conv_id, turn, {TOKENS.format('question')} AS a, {TOKENS.format('text')} AS b, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM u WHERE question IS NOT NULL),
 g AS (SELECT *, {GRAMS.format('q')} AS ga, {GRAMS.format('t')} AS gb FROM p), s AS (SELECT conv_id, turn, round(0.3e0 * (CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0e0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) END) + 0.4e0 * (CASE WHEN len(a) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / len(a) END), 6) AS affinity FROM g)
 SELECT *, CASE WHEN affinity > 0.15 THEN 'used' WHEN affinity > 0.05 THEN 'partial' ELSE 'unused' END AS signal FROM s""")
def _(spark, d):
    """The turn before as the injected memory."""
    a = _turns(spark, d).where("question is not null").select("conv_id", "turn", F.round(D.affinity(F.col("question"), F.col("text")), 6).alias("affinity"))
    return a.withColumn("signal", D.affinity_signal(F.col("affinity")))
