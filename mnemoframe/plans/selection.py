"""Queries of constrained selections with their oracle SQL: each document is a candidate of one benchmark passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.operators import selection
from mnemoframe.plans.catalog import query
from mnemoframe.plans.expansion import asked
from mnemoframe.sources.tables import read

_N = "(SELECT max(item_id) + 1 FROM benchmark)"
CANDIDATES = f"""c AS MATERIALIZED (SELECT doc_id % {_N} AS query_id, doc_id AS memory_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'episode' ELSE 'fact' END AS scope, doc_id % 6 = 0 AS summary, (doc_id * 37 % 101) / 100e0 AS activation,
 (doc_id * 53 % 97) / 100e0 AS context, (doc_id * 71 % 89) / 100e0 AS base, (doc_id * 29 % 7) / 10e0 AS temporal, (doc_id * 31 % 5) / 10e0 AS spread FROM documents)"""
_ASKED = "asked AS (SELECT item_id AS query_id, word FROM (SELECT item_id, word, min(pos) AS pos FROM (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[a-zA-Z]{4,}'), lambda x: lower(x)) AS ws FROM benchmark)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 6)"


def candidates(spark, d):
    n = read(spark, d, "benchmark").agg(F.max("item_id") + 1).first()[0]
    return read(spark, d, "documents").selectExpr(
        f"doc_id % {n} as query_id", "doc_id as memory_id", "text as content", "if(doc_id % 3 = 0, 'episode', 'fact') as scope", "doc_id % 6 = 0 as summary", "(doc_id * 37 % 101) / 100D as activation",
        "(doc_id * 53 % 97) / 100D as context", "(doc_id * 71 % 89) / 100D as base", "(doc_id * 29 % 7) / 10D as temporal", "(doc_id * 31 % 5) / 10D as spread",
    )


O4 = f"""WITH RECURSIVE {CANDIDATES}, {_ASKED}, wanted AS (SELECT query_id, list(word) AS ws FROM asked GROUP BY query_id),
 p AS MATERIALIZED (SELECT query_id, memory_id, content, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id) AS size FROM c WINDOW w AS (PARTITION BY query_id ORDER BY activation DESC, memory_id)),
 h AS MATERIALIZED (SELECT p.query_id, any_value(size) AS size, any_value(ws) AS ws, list({{'id': memory_id, 'h': list_filter(ws, lambda x: contains(lower(coalesce(content, '')), x))}} ORDER BY place) AS rows FROM p JOIN wanted USING (query_id) WHERE place <= 12 GROUP BY p.query_id),
 r AS (SELECT query_id, 0 AS k, NULL::BIGINT AS memory_id, rows, ws AS open, len(ws) AS n FROM h WHERE size > 6 UNION ALL
  SELECT query_id, k + 1, rows[i].id, list_concat(rows[:i - 1], rows[i + 1:]), list_filter(open, lambda x: NOT list_contains(rows[i].h, x)), n
  FROM (SELECT *, list_position(scores, list_max(scores)) AS i FROM (SELECT *, list_transform(rows, lambda x, i: 0.6e0 * (1 / i) + 0.4e0 * (len(list_filter(x.h, lambda y: list_contains(open, y))) / n)) AS scores FROM r WHERE k < 6 AND len(rows) > 0)))
 SELECT query_id, memory_id, k AS rank FROM r WHERE k > 0 UNION ALL SELECT query_id, memory_id, place FROM p WHERE place <= 6 AND size <= 6"""


@query("o4_covering", O4)
def _(spark, d):
    return selection.covering(candidates(spark, d), asked(spark, d).select("query_id", "word"), 6)


def _take(name: str, before: str, order: str, most: int, where: str = "true") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT query_id, memory_id FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, activation DESC, memory_id) AS k FROM u WHERE {where} AND (query_id, memory_id) NOT IN (SELECT (query_id, memory_id) FROM {before})) x WHERE k <= {most} - (SELECT count(*) FROM {before} y WHERE y.query_id = x.query_id))"


O5 = f"""WITH {CANDIDATES}, sized AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS size FROM c), u AS MATERIALIZED (SELECT * FROM sized WHERE size > 10 QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY activation DESC, memory_id) = 1), s0 AS (SELECT query_id, memory_id FROM u WHERE false),
 {_take('s1', 's0', 'activation', 5)}, {_take('s2', 's1', 'context', 7)}, {_take('s3', 's2', 'base', 9)}, {_take('s4', 's3', 'temporal', 9, 'temporal > 0')}, {_take('s5', 's4', 'spread', 9, 'spread > 0')}, {_take('s6', 's5', 'activation', 10, "scope = 'episode' AND NOT summary")}, {_take('s7', 's6', 'activation', 10)},
 chosen AS (SELECT query_id, memory_id FROM s7 UNION ALL SELECT query_id, memory_id FROM sized WHERE size <= 10)
 SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, memory_id) AS rank FROM chosen JOIN c USING (query_id, memory_id)"""


@query("o5_coordinated", O5)
def _(spark, d):
    return selection.coordinated(candidates(spark, d), 10, temporal=True)


@query("o6_within_shares")
def _(spark, d):
    """Chunks of a budget from whole documents: their estimated tokens, priorities by a rule."""
    rows = candidates(spark, d).select("query_id", F.col("memory_id").alias("text_id"), "content", F.expr("cast(memory_id * 13 % 10 as int)").alias("priority"), T.estimated_tokens(F.col("content")).cast("int").alias("tokens"))
    return selection.within_shares(rows, 2000)
