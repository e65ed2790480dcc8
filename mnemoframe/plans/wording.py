"""Queries of wording and style with their oracle SQL, over all turns, events and documents and some messages written here.

The messages hold the reasons, symbols and stack traces that the tables' invented prose lacks; their ids are negative.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import signals as G
from mnemoframe.functions import text as T
from mnemoframe.functions import wording as W
from mnemoframe.operators import insight, style
from mnemoframe.plans.catalog import CLEAN, GRAMS, query
from mnemoframe.plans.signals import TEXTS, _quoted, count, has, matches, texts
from mnemoframe.sources.tables import read

NOTES = [
    "we chose parquet because: it is columnar and small. next", "因为数据太大了，所以要分区。", "由于 网络不稳定所以失败了！好", "because x", "no reason given at all",
    "TypeError: foo is not a function here\n    at run (/src/app.ts:10:5)\n    at main (/src/index.ts:3:1)\n    at <anonymous>:1:1", 'Traceback (most recent call last):\n  File "a.py", line 3, in f\n  File "b.py", line 12\nValueError: a long message of the error', "错误：数据库连接失败了请检查网络设置\n  at x (q.js:1:2)",
    "see `parse_line` and `toString` and `lower_case`", "call getUser then set_value and forEach", "use `one_two` with fooBar", "昨天去了公园，前天下雨", "Yesterday we met, today we rest, Tomorrow we go", "上周和上个月都忙 last week", "第一```code```吗？", "a\nb\nc?",
]
GIVEN = f"WITH {TEXTS}, given AS (SELECT * FROM texts UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1000 - k}, {_quoted(m)})" for k, m in enumerate(NOTES)) + ") v(id, text)), n AS (SELECT id, text, length(text) AS n FROM given)"


def _given(spark, d):
    return texts(spark, d).unionAll(spark.createDataFrame([(-1000 - k, m) for k, m in enumerate(NOTES)], "id long, text string"))


_MOOD_SUM = " + ".join(f"CASE WHEN contains(text, {_quoted(e)}) THEN {float(v)!r}e0 ELSE 0e0 END" for e, v in G.EMOJI_MOOD.items())
_RULES = " ".join(f"WHEN {has(r, 'm') + ' > 0' if isinstance(r, list) else matches(r, 'm')} THEN {{'label': '{label}', 'confidence': {sure!r}e0}}" for label, sure, r in W.EMOTION_RULES)
LABELS = f"""{GIVEN}, l AS (SELECT id, text, lower(text) AS m, ({_MOOD_SUM}) / nullif({has(list(G.EMOJI_MOOD), 'text')}, 0) AS mood FROM given),
 e AS (SELECT id, CASE WHEN {matches(W.LOUD)} AND {has(G.NEGATIVE)} > 0 THEN {{'label': 'anger', 'confidence': 0.9e0}} {_RULES}
 WHEN mood > 0.3 THEN {{'label': 'joy', 'confidence': least(0.8e0, mood)}} WHEN mood < -0.3 THEN {{'label': 'sadness', 'confidence': least(0.8e0, -mood)}} ELSE {{'label': 'neutral', 'confidence': 0.3e0}} END AS e FROM l)"""


@query("x2_emotion_label", f"{LABELS} SELECT id, e.label AS label, round(e.confidence, 6) AS confidence FROM e")
def _(spark, d):
    return _given(spark, d).select("id", W.emotion_label(F.col("text")).alias("e")).select("id", "e.label", F.round("e.confidence", 6).alias("confidence"))


_AXES = ", ".join(f"CASE e.label {' '.join(f'WHEN {_quoted(n)} THEN {v[k]!r}e0' for n, v in W.PADCN.items())} ELSE 0e0 END AS {a}" for k, a in enumerate(W.AXES))


@query("x2_emotion_axes", f"{LABELS} SELECT id, {_AXES} FROM e")
def _(spark, d):
    return _given(spark, d).select("id", W.padcn(W.emotion_label(F.col("text"))["label"]).alias("p")).select("id", "p.*")


@query("t14_reasons", f"{GIVEN} SELECT id, nullif(regexp_replace(regexp_extract(text, {_quoted(W.REASON)}, 1), '^\\s+|\\s+$', '', 'g'), '') AS because FROM given")
def _(spark, d):
    return _given(spark, d).select("id", W.reason(F.col("text")).alias("because"))


_DATED = "text"
for _pattern, _by in W.DATES:
    _DATED = f"regexp_replace({_DATED}, {_quoted(_pattern)}, {_quoted(_by) if isinstance(_by, str) else f'CAST(day + {_by} AS VARCHAR)'}, 'g')"


@query("t30_absolute_dates", f"{GIVEN}, y AS (SELECT id, text, DATE '2024-02-28' + CAST(abs(id) % 5 AS INT) AS day FROM given) SELECT id, {_DATED} AS content FROM y")
def _(spark, d):
    return _given(spark, d).select("id", W.dated(F.col("text"), F.expr("date_add(date'2024-02-28', cast(abs(id) % 5 as int))")).alias("content"))


@query("t27_code_symbols", f"""{GIVEN}, s AS (SELECT id, list_distinct_in_order AS q, names FROM (SELECT id, regexp_extract_all(text, {_quoted(W.BACKTICKED)}, 1) AS q0, list_filter(regexp_extract_all(text, {_quoted(W.IDENTIFIER)}, 1), lambda x: x NOT IN ({', '.join(map(_quoted, W.NO_SYMBOLS))})) AS names,
 list_filter(q0, lambda x, i: list_position(q0, x) = i) AS list_distinct_in_order FROM given)),
 b AS (SELECT id, CASE WHEN len(q) >= 2 THEN q ELSE list_concat(q, names) END AS a FROM s) SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:2], ' ') AS symbols FROM b""")
def _(spark, d):
    return _given(spark, d).select("id", F.array_join(W.code_symbols(F.col("text")), " ").alias("symbols"))


@query("t27_stack_frames", f"""{GIVEN}, l AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: NOT {matches(W.TRACEBACK, 'x')}) AS ls FROM given),
 f AS (SELECT id, list_filter(ls, lambda x: {matches(W.ERROR_LINE, 'x')})[1] AS error, list_filter(list_transform(ls, lambda x: CASE WHEN {matches(W.AT_LINE, 'x')} THEN regexp_extract(x, {_quoted(W.AT_FRAME)}, 1)
 WHEN {matches(W.FILE_FRAME, 'x')} THEN regexp_extract(x, {_quoted(W.FILE_FRAME)}, 1) || ':' || regexp_extract(x, {_quoted(W.FILE_FRAME)}, 2) ELSE '' END), lambda x: x <> '')[1:5] AS frames FROM l)
 SELECT id, coalesce(substring(regexp_replace(error, '^\\s+|\\s+$', '', 'g'), 1, 150), '') AS error, array_to_string(frames, ' ') AS frames FROM f WHERE len(frames) > 0""")
def _(spark, d):
    got = _given(spark, d).select("id", W.stack_frames(F.col("text")).alias("s")).where("s is not null")
    return got.select("id", "s.error", F.array_join("s.frames", " ").alias("frames"))


_STYLE = f"[least(1e0, n / 2000), {count('[？?]', 'text')} / greatest(1e0, n / 100), CASE WHEN contains(text, '```') THEN 1e0 ELSE 0e0 END, CASE WHEN regexp_matches(text, '[的了吗呢吧啊]') THEN 0.3e0 ELSE 0.7e0 END, least(1e0, (n - length(replace(text, chr(10), ''))) / 20)]"


@query("t28_style", f"{GIVEN}, v AS (SELECT id, {_STYLE} AS v FROM n) SELECT id, " + ", ".join(f"round(v[{k + 1}], 6) AS {s}" for k, s in enumerate(W.STYLE)) + ", round(list_dot_product(v, [0.5e0, 0.3e0, 0.3e0, 0.5e0, 0.5e0]) / (sqrt(list_dot_product(v, v)) * sqrt(0.93e0) + 1e-8), 6) AS likeness FROM v")
def _(spark, d):
    v = _given(spark, d).select("id", W.style_vector(F.col("text")).alias("v"))
    return v.select("id", *[F.round(F.col("v")[k], 6).alias(s) for k, s in enumerate(W.STYLE)], F.round(W.vector_cosine(F.col("v"), F.array(*map(F.lit, (0.5, 0.3, 0.3, 0.5, 0.5)))), 6).alias("likeness"))


@query("t24_tier", f"WITH e AS (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 1e6 AS age FROM events) SELECT event_id, CASE WHEN age IS NULL OR age < 300 THEN 'verbatim' WHEN age < 3600 THEN 'summary' ELSE 'compressed_fact' END AS tier FROM e")
def _(spark, d):
    age = (F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")) - insight.micros("ts")) / 1e6
    return read(spark, d, "events").select("event_id", W.tier(age).alias("tier"))


@query("x10_pace", """WITH t AS (SELECT conv_id, turn, text, turn * (1 + conv_id % 7 * 60) AS s FROM conversations),
 g AS (SELECT conv_id, turn, length(text) AS own, count(text) OVER w AS n, avg(length(text)) OVER w AS mean, max(s) OVER w - min(s) OVER w AS span FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 r AS (SELECT conv_id, turn, n, CASE WHEN n < 2 THEN own ELSE mean END AS m, CASE WHEN n >= 2 THEN n / greatest(span / 60, 0.5e0) ELSE 0e0 END AS r FROM g)
 SELECT conv_id, turn, round(m, 4) AS mean_length, round(r, 4) AS per_minute, CASE WHEN n >= 3 AND (r > 3 OR r > 1 AND m < 20) THEN 'rapid' WHEN r > 0 AND r < 0.3 AND m > 100 THEN 'slow' ELSE 'normal' END AS speed FROM r""")
def _(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text", F.timestamp_seconds(F.expr("turn * (1 + conv_id % 7 * 60)")).alias("ts"))
    return style.pace(turns, "conv_id", "turn")



@query("m16_pressure", f"""WITH RECURSIVE d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (conv_id + turn * 7) % 10 / 10e0 - 0.2e0 AS signal,
 (CASE WHEN length(text) < 10 THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN conv_id % 3 = 0 THEN 0.25e0 ELSE 0e0 END) + (CASE WHEN turn % 4 = 1 THEN 0.1e0 ELSE 0e0 END) AS force FROM conversations),
 z AS (SELECT conv_id, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS k, 0e0 AS f, 0e0 AS g, 0e0 AS s, 0e0 AS v, 0.3e0 AS c FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv_id, turn, k, f, g, s, greatest(-0.5e0, least(0.5e0, v)), CASE WHEN f > 0.5 AND s > 0.5 THEN least(1e0, c + 0.05e0) ELSE greatest(0.1e0, c * 0.99e0) END FROM
 (SELECT *, greatest(0e0, least(1e0, s0 + v)) AS s FROM (SELECT *, v0 - 0.15e0 * s0 + force + 0.1e0 * f * c - 0.3e0 * v0 AS v FROM (SELECT *, greatest(0e0, least(1e0, 0.9e0 * f0 + 0.3e0 * g)) AS f FROM
 (SELECT d.conv_id, d.turn, d.k, d.force, z.f AS f0, z.s AS s0, z.v AS v0, z.c, d.signal * (1 + z.s * z.c) AS g FROM z JOIN d ON d.conv_id = z.conv_id AND d.k = z.k + 1))))),
 p AS (SELECT *, greatest(f, s) AS top, greatest(g, v) AS speed FROM z WHERE k > 0)
 SELECT conv_id, turn, round(f, 6) AS frustration, round(s, 6) AS stress, round(c, 6) AS coupling, CASE WHEN top > 0.7 THEN 'critical' WHEN top > 0.4 AND (g > 0 OR v > 0) THEN 'building' WHEN top > 0.3 AND v < -0.05 THEN 'recovering' ELSE 'calm' END AS phase,
 CASE WHEN top > 0.7 THEN 0 WHEN speed > 0.03 AND top > 0.3 AND ceil((0.8e0 - top) / speed) BETWEEN 0 AND 10 THEN CAST(ceil((0.8e0 - top) / speed) AS BIGINT) END AS turns_left FROM p""")
def _(spark, d):
    signal = F.expr("(conv_id + turn * 7) % 10 / 10 - 0.2").cast("double")
    force = F.expr("if(length(text) < 10, 0.15D, 0D) + if(conv_id % 3 = 0, 0.25D, 0D) + if(turn % 4 = 1, 0.1D, 0D)")
    got = style.pressure(read(spark, d, "conversations").select("conv_id", "turn", F.array(signal, force).alias("drive")), "conv_id", ["turn"])
    state = [F.col(c) for c in ("frustration", "signal", "stress", "velocity")]
    return got.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("frustration", "stress", "coupling")], style.pressure_phase(*state).alias("phase"), style.turns_to_breakdown(*state).alias("turns_left"))


_DIMS = ", ".join(f"greatest(0e0, least(1e0, a[{k}] + (b[{k}] - a[{k}]) * (CASE WHEN a[6] < 20 THEN 0.2e0 ELSE 0.05e0 END) * b[6]))" for k in range(1, 6))


@query("m22_style_preference", f"""WITH n AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations), r AS (SELECT conv_id % 5 AS user_id, conv_id, turn, list_append({_STYLE}, CASE WHEN (conv_id + turn) % 3 = 0 THEN -1e0 ELSE 1e0 END) AS b FROM n),
 l AS (SELECT user_id, list(b ORDER BY conv_id, turn) AS l FROM r GROUP BY user_id), z AS (SELECT user_id, list_reduce(list_prepend([0.5e0, 0.3e0, 0.3e0, 0.5e0, 0.5e0, 0e0], l), lambda a, b: [{_DIMS}, a[6] + 1]) AS z FROM l)
 SELECT user_id, {', '.join(f'round(z[{k + 1}], 6) AS {s}' for k, s in enumerate(W.STYLE))}, CAST(z[6] AS BIGINT) AS samples FROM z""")
def _(spark, d):
    """Every turn is a reply to one of five users; a third of them are disliked."""
    rows = read(spark, d, "conversations").select((F.col("conv_id") % 5).alias("user_id"), "conv_id", "turn", F.concat(W.style_vector(F.col("text")), F.expr("array(if((conv_id + turn) % 3 = 0, -1D, 1D))")).alias("reply"))
    got = style.style_preference(rows, "user_id", ["conv_id", "turn"], W.STYLE)
    last = got.groupBy("user_id").agg(F.max_by(F.struct(*W.STYLE, "samples"), "samples").alias("z"))
    return last.select("user_id", *[F.round(f"z.{s}", 6).alias(s) for s in W.STYLE], F.col("z.samples").cast("long").alias("samples"))


@query("t4_weighted_trigrams", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {CLEAN.format('text')} AS a, lag({CLEAN.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT * FROM t WHERE b IS NOT NULL),
 g AS (SELECT id, list_filter({GRAMS.format('a')}, lambda x: length(x) = 3) AS a, list_filter({GRAMS.format('b')}, lambda x: length(x) = 3) AS b FROM p), w AS (SELECT gram, ln(1 + (SELECT count(*) FROM p) / count(*)) AS weight FROM (SELECT unnest(a) AS gram FROM g) GROUP BY gram),
 u AS (SELECT id, unnest(list_distinct(list_concat(a, b))) AS gram, a, b FROM g WHERE len(a) > 0 AND len(b) > 0), s AS (SELECT id, sum(CASE WHEN list_contains(a, u.gram) AND list_contains(b, u.gram) THEN coalesce(weight, 1) ELSE 0 END) / sum(coalesce(weight, 1)) AS s FROM u LEFT JOIN w ON w.gram = u.gram GROUP BY id)
 SELECT p.id, round(coalesce(s, 0), 6) AS similarity FROM p LEFT JOIN s ON s.id = p.id""")
def _(spark, d):
    """Each turn against the one before; a trigram weighs by the share of turns that hold it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), F.lag("text").over(w).alias("b")).where("b is not null")
    n = pairs.agg(F.count("*").alias("n"))
    weights = pairs.select(F.explode(T.trigrams(F.col("a"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", F.log1p(F.col("n") / F.col("df")).alias("weight"))
    return style.weighted_similarity(pairs, weights).select("id", F.round("similarity", 6).alias("similarity"))


@query("r33_topics", r"""WITH q AS (SELECT doc_id AS id, list_distinct(list_transform(regexp_extract_all(text, '[一-鿿]{2,}|[a-zA-Z]{3,}'), lambda x: lower(x))) AS ws FROM documents WHERE doc_id % 100 = 0), t AS (SELECT item_id AS id, list_distinct(list_transform(regexp_extract_all(text, '[一-鿿]{2,}|[a-zA-Z]{3,}'), lambda x: lower(x))) AS ws FROM benchmark),
 h AS (SELECT q.id AS query_id, t.id AS topic_id, len(list_intersect(q.ws, t.ws)) / least(len(q.ws), len(t.ws)) AS overlap FROM q, t WHERE len(q.ws) > 0 AND len(t.ws) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, topic_id) AS k FROM h WHERE overlap >= 0.2)
 SELECT query_id, topic_id, round(overlap, 6) AS overlap FROM r WHERE k <= 5""")
def _(spark, d):
    """The stated query set, every document whose id is divisible by 100, against all benchmark passages as topics."""
    queries = read(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), "text")
    got = style.topics_for(queries, read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return got.select("query_id", "topic_id", F.round("overlap", 6).alias("overlap"))
