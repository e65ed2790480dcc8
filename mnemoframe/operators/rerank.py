"""Reranks of candidate lists: interference, diversity, token budgets. Groups are candidates of one query, bounded by the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T

SUMMARY_SCOPES = ("fact", "consolidated")


def _similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _prepared(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_grams", T.trigrams(F.col("content")))


def interference(candidates: DataFrame, top_n: int) -> DataFrame:
    """Falling score; what resembles an earlier kept row is damped, more so when of like age. (query_id, memory_id, activation).

    candidates: (query_id, memory_id, content, scope, age_ms, score). Ties of score go by memory_id, of similarity to the better row.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for r in rows.sort_values(["score", "memory_id"], ascending=[False, True]).itertuples():
            grams = set(r.grams)
            near, age = max(((_similarity(grams, g), -k, a) for k, (g, a) in enumerate(kept)), default=(0.0, 0, 0))[::2]
            if kept and age > 0 and r.age_ms > 0:
                near = min(1.0, near * (1 + 0.3 * np.exp(-2 * abs(np.log(r.age_ms + 1) - np.log(age + 1)))))
            if r.scope in SUMMARY_SCOPES or r.content.startswith(("[summary]", "[Session")):
                damp = 0.5 if near > 0.7 else 0.8 if near > 0.5 else 1.0
            else:
                damp = 0.3 if near > 0.5 else 0.7 if near > 0.3 else 1.0
            if r.score * damp > 0.001:
                kept.append((grams, r.age_ms))
                out.append((r.query_id, r.memory_id, r.score * damp))
            if len(out) >= top_n:
                break
        return pd.DataFrame(out, columns=["query_id", "memory_id", "activation"])

    rows = _prepared(candidates).withColumnRenamed("_grams", "grams").withColumn("content", F.coalesce("content", F.lit("")))
    return rows.groupBy("query_id").applyInPandas(walk, "query_id long, memory_id long, activation double")


def diversified(candidates: DataFrame, top_n: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: each pick maximises ``weight`` * score less the rest of the weight times its likeness to a pick before. (query_id, memory_id, rank)."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "memory_id"], ascending=[False, True]).reset_index(drop=True)
        grams, score = [set(g) for g in rows["grams"]], rows["score"].to_numpy()
        near, left, order = np.zeros(len(rows)), np.ones(len(rows), dtype=bool), []
        while len(order) < min(top_n, len(rows)):
            best = int(np.argmax(np.where(left, weight * score - (1 - weight) * near, -np.inf)))
            left[best] = False
            order.append(best)
            for k in np.flatnonzero(left):
                near[k] = max(near[k], _similarity(grams[k], grams[best]))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[order].to_numpy(), "memory_id": rows["memory_id"].iloc[order].to_numpy(), "rank": range(1, len(order) + 1)})

    return _prepared(candidates).withColumnRenamed("_grams", "grams").groupBy("query_id").applyInPandas(pick, "query_id long, memory_id long, rank int")


def within_budget(rows: DataFrame, key: list[str], order: list[str], budget: float) -> DataFrame:
    """The longest prefix of each key's rows whose estimated tokens stay in the budget."""
    cost = 1.5 * F.regexp_count("content", F.lit(T.CJK)) + 1.3 * F.regexp_count("content", F.lit("[a-zA-Z]+")) + 10
    used = F.sum(cost).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", F.round(used, 6)).where(F.col("used") <= budget)


def working_memory(turns: DataFrame, session: str, order: str, per_session: int = 20, sessions: int = 100) -> DataFrame:
    """Latest rows of each of the sessions that were active last; ties by session."""
    active = turns.groupBy(session).agg(F.max(order).alias("_last")).orderBy(F.desc("_last"), session).limit(sessions).select(session)
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.join(F.broadcast(active), session, "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= per_session).drop("_rank")
