"""Queries of seeded sampling and the bandit with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import sampling
from mnemoframe.operators import bandit
from mnemoframe.plans.catalog import query
from mnemoframe.sources.tables import read

_U = "((CAST('0x' || substring(md5({0}), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def _gamma(shape: str, seed: str) -> str:
    """SQL of a gamma sample: the first of the proposals that is taken."""
    s = f"greatest(0.01e0, {shape})"
    d = f"(CASE WHEN {s} < 1 THEN {s} + 1 ELSE {s} END - 1e0 / 3)"
    key = lambda mark: _U.format(f"({seed}) || ':' || k || '{mark}'")
    x = f"sqrt(-2 * ln({key('a')})) * cos(2 * pi() * {key('b')})"
    rows = f"list_transform(list_transform(range({sampling.TRIES}), lambda k: {{'x': {x}, 'u': {key('u')}}}), lambda t: {{'x': t.x, 'u': t.u, 'w': 1 + t.x / sqrt(9 * {d})}})"
    ok = f"t.w > 0 AND (t.u < 1 - 0.0331e0 * pow(t.x, 4) OR ln(t.u) < 0.5e0 * t.x * t.x + {d} * (1 - pow(t.w, 3) + ln(CASE WHEN t.w > 0 THEN pow(t.w, 3) ELSE 1 END)))"
    return f"({d} * pow(list_filter({rows}, lambda t: {ok})[1].w, 3) * CASE WHEN {s} < 1 THEN pow({_U.format(f'({seed}) || {chr(39)}:p{chr(39)}')}, 1 / {s}) ELSE 1 END)"


@query("m13_samples", f"SELECT c_custkey, round({_gamma('(c_custkey % 40) / 8e0', 'CAST(c_custkey AS VARCHAR)')}, 6) AS gamma, round({_U.format('c_custkey || ' + chr(39) + ':0' + chr(39))}, 9) AS uniform FROM customer")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("seed"))
    return c.select("c_custkey", F.round(sampling.gamma((F.col("c_custkey") % 40) / 8, F.col("seed")), 6).alias("gamma"), F.round(sampling.uniform(F.col("seed"), F.lit("0")), 9).alias("uniform"))


ARMS = """rewards AS (SELECT event_type || ':' || user_id % 10 AS param, event_id % 3 AS arm, event_id, (CAST(floor(value) AS BIGINT) % 11) / 10e0 AS reward FROM events), arms AS (SELECT DISTINCT param, a AS arm FROM rewards, range(3) r(a)),
 faded AS (SELECT *, pow(0.995e0, row_number() OVER (PARTITION BY param, arm ORDER BY event_id DESC)) AS w FROM rewards), sums AS (SELECT param, arm, sum(reward * w) AS won, sum((1 - reward) * w) AS lost, count(*) AS n FROM faded GROUP BY ALL),
 belief AS MATERIALIZED (SELECT param, arm, pow(0.995e0, coalesce(n, 0)) + 5 * coalesce(won, 0) AS alpha, pow(0.995e0, coalesce(n, 0)) + 5 * coalesce(lost, 0) AS beta, coalesce(n, 0) AS pulls FROM arms LEFT JOIN sums USING (param, arm))"""


def beliefs(spark, d):
    rewards = read(spark, d, "events").selectExpr("concat(event_type, ':', user_id % 10) as param", "event_id % 3 as arm", "event_id", "(cast(floor(value) as long) % 11) / 10D as reward")
    arms = rewards.select("param").distinct().select("param", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("arm"), F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"))
    return bandit.updated_arms(arms, rewards, ["event_id"])


@query("l24_beliefs", f"WITH {ARMS} SELECT param, arm, round(alpha, 6) AS alpha, round(beta, 6) AS beta, pulls FROM belief")
def _(spark, d):
    return beliefs(spark, d).select("param", "arm", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "pulls")


@query("l24_chosen_arms", f"""WITH {ARMS}, drawn AS (SELECT param, arm, {_gamma('alpha', "param || ':' || arm || ':7x'")} AS x, {_gamma('beta', "param || ':' || arm || ':7y'")} AS y FROM belief)
 SELECT param, arm, round(x / (x + y), 6) AS sample FROM drawn QUALIFY row_number() OVER (PARTITION BY param ORDER BY x / (x + y) DESC, arm) = 1""")
def _(spark, d):
    return bandit.chosen_arms(beliefs(spark, d), F.lit("7")).withColumn("sample", F.round("sample", 6))
