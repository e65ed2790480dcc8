"""Selections from candidate lists under constraints: greedy cover, quotas of several rankings, and a token budget with minimum shares.

Which candidates can be chosen at all is bounded by windows in the JVM before a query's rows come together: twice the wanted number of
each ranking. The choice itself goes step by step over these few rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T


def _ranked(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def covering(candidates: DataFrame, constraints: DataFrame, top_n: int) -> DataFrame:
    """(query_id, memory_id, rank): of each query's best 2 * top_n rows those that together hold most of its constraints.

    Each pick maximises 0.6 / (1 + place among the rows left) + 0.4 * (constraints newly held) / (all constraints); a constraint is held if
    its word stands in the content in any case. Queries without constraints, or of top_n rows or fewer, keep their order. candidates:
    (query_id, memory_id, content, activation), ties of activation by memory_id; constraints: (query_id, word), few a query.
    """
    best = candidates.withColumn("place", _ranked([F.desc("activation"), F.col("memory_id")])).where(F.col("place") <= 2 * top_n)
    size = candidates.groupBy("query_id").agg(F.count("*").alias("size"))
    wanted = constraints.groupBy("query_id").agg(F.sort_array(F.collect_set(F.lower("word"))).alias("wanted"))
    rows = best.join(size, "query_id").join(wanted, "query_id", "left")
    holds = F.transform(F.coalesce("wanted", F.array().cast("array<string>")), lambda w: F.contains(F.lower(F.coalesce("content", F.lit(""))), w))
    flags = rows.select("query_id", "memory_id", "place", holds.alias("holds"), (F.col("size") > top_n).alias("crowded"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        left = [(m, set(k for k, h in enumerate(holds) if h)) for m, holds in zip(rows["memory_id"], rows["holds"])]
        n, out = len(rows["holds"].iloc[0]), []
        open_ones = set(range(n))
        if not n or not rows["crowded"].iloc[0]:
            out, left = [m for m, _ in left[:top_n]], []
        while left and len(out) < top_n:
            score = [0.6 * (1 / (1 + i)) + 0.4 * (len(h & open_ones) / max(n, 1)) for i, (_, h) in enumerate(left)]
            m, h = left.pop(score.index(max(score)))
            out.append(m)
            open_ones -= h
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "memory_id": out, "rank": range(1, len(out) + 1)})

    return flags.groupBy("query_id").applyInPandas(pick, "query_id long, memory_id long, rank int")


# Up to which share of the places each ranking may fill, in turn.
QUOTAS = (("activation", 0.5), ("context", 0.7), ("base", 0.9))


def coordinated(candidates: DataFrame, top_n: int, temporal: bool = False) -> DataFrame:
    """(query_id, memory_id, rank): places filled by several rankings in turn, then ordered by activation; equal contents count once.

    Half by activation, up to 0.7 by context, 0.9 by base, then up to top_n - 1 by temporal (of temporal queries, above 0) and by spread
    (above 0), episodes that are no summaries, and the rest by activation. Under six places, or if all fit, the order by activation stays.
    candidates: (query_id, memory_id, content, scope, summary, activation, context, base, temporal, spread); ties by activation, then id.
    """
    rankings = {"activation": None, "context": None, "base": None, "temporal": F.col("temporal") > 0, "spread": F.col("spread") > 0, "episode": (F.col("scope") == "episode") & ~F.coalesce("summary", F.lit(False))}
    first = Window.partitionBy("query_id", F.sha2(F.coalesce("content", F.lit("")), 256)).orderBy(F.desc("activation"), "memory_id")
    size = candidates.groupBy("query_id").agg(F.count("*").alias("size"))
    rows = candidates.withColumn("copy", F.row_number().over(first)).join(size, "query_id")
    for name, holds in rankings.items():
        value = F.col(name if name != "episode" else "activation")
        able = F.lit(True) if holds is None else F.coalesce(holds, F.lit(False))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(able & (F.col("copy") == 1)), F.desc(value), F.desc("activation"), "memory_id"))
        rows = rows.withColumn(f"by_{name}", F.when(able & (F.col("copy") == 1), place))
    near = None
    for name in rankings:
        near = F.col(f"by_{name}") <= 2 * top_n if near is None else near | (F.col(f"by_{name}") <= 2 * top_n)
    near = near | (_ranked([F.desc("activation"), F.col("memory_id")]) <= top_n)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["activation", "memory_id"], ascending=[False, True])
        if top_n < 6 or rows["size"].iloc[0] <= top_n:
            chosen = rows["memory_id"].tolist()[:top_n]
        else:
            chosen = []
            turns = [(name, math.ceil(top_n * share)) for name, share in QUOTAS] + [("temporal", top_n - 1)] * temporal + [("spread", top_n - 1), ("episode", top_n), ("activation", top_n)]
            for name, most in turns:
                for m in rows[rows[f"by_{name}"].notna()].sort_values(f"by_{name}")["memory_id"]:
                    if len(chosen) >= most:
                        break
                    if m not in chosen:
                        chosen.append(m)
            taken = set(chosen)
            chosen = [m for m in rows["memory_id"] if m in taken]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "memory_id": chosen, "rank": range(1, len(chosen) + 1)})

    kept = rows.withColumn("_near", near).where("_near").select("query_id", "memory_id", "activation", "size", *[f"by_{name}" for name in rankings])
    return kept.groupBy("query_id").applyInPandas(fill, "query_id long, memory_id long, rank int")


# Words by which a text belongs to a category, the first that fits; places that a category is given before the rest.
CATEGORIES = {
    "memory": ("memory", "记忆", "predictive", "associative", "search result"),
    "persona": ("persona", "emotion", "drift", "面向", "当前对话者", "情绪感知", "用户档案", "心智模型", "mental model"),
    "rules": ("rule", "plan", "epistemic", "知识边界", "metacognit", "认知"),
    "context": ("flow", "skill", "lorebook", "goal", "工作流", "主题记忆"),
}
MEMORY_SLOTS, ALIKE = 3, 0.4


def category(content: Column) -> Column:
    out = None
    for name, words in CATEGORIES.items():
        found = F.lower(content).rlike("|".join(words))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("other")


def within_shares(texts: DataFrame, budget: int = 2000, multiplier: float = 1.0) -> DataFrame:
    """(query_id, text_id, rank): texts within a token budget, with a minimum for each category, without those like an earlier one.

    The three memories of highest priority come first, then the first of each other category, then all others by priority; what exceeds
    the budget is passed over. Of two chosen texts whose trigrams are alike by over 0.4 the later goes. Equal contents count once, ties go
    by category, then text_id; a text that alone exceeds the budget, first in its category, uses up the category's turn. texts: (query_id,
    text_id, content, priority, tokens), one token at least each, so that the texts that can fill a budget are bounded by it.
    """
    limit = int(math.floor(budget * multiplier + 0.5))
    once = F.row_number().over(Window.partitionBy("query_id", F.sha2("content", 256)).orderBy("text_id"))
    order = [name for name in (*CATEGORIES, "other")]
    kind = category(F.col("content"))
    rows = texts.where("content is not null").withColumn("_n", once).where("_n = 1").withColumn("kind", F.array_position(F.array(*map(F.lit, order)), kind)).where("tokens >= 1")
    leading = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("priority"), "text_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "kind", "tokens").orderBy(F.desc("priority"), "text_id"))
    # of one category and size no more than fill the budget, and the memory's three, can ever be chosen
    fits = (F.col("tokens") <= limit) & (F.col("_p") <= F.ceil(F.lit(limit) / F.col("tokens")) + MEMORY_SLOTS)
    rows = rows.withColumn("_p", place).withColumn("_l", leading).where(fits | (F.col("_l") <= MEMORY_SLOTS))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["priority", "kind", "text_id"], ascending=[False, True, True])
        items = list(zip(rows["text_id"], rows["kind"], rows["tokens"], rows["grams"]))
        used, chosen = 0, []
        for k in range(1, len(order) + 1):
            mine = [x for x in items if x[1] == k]
            for _ in range(min(MEMORY_SLOTS if k == 1 else 1, len(mine))):
                if used + mine[0][2] <= limit:
                    used += mine[0][2]
                    chosen.append(mine.pop(0))
        taken = {x[0] for x in chosen}
        for x in items:
            if x[0] not in taken and used + x[2] <= limit:
                used += x[2]
                chosen.append(x)
        out: list[tuple[int, set]] = []
        for text_id, _, _, grams in chosen:
            mine = set(grams)
            if not any(mine and g and len(mine & g) / len(mine | g) > ALIKE for _, g in out):
                out.append((text_id, mine))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "text_id": [x for x, _ in out], "rank": range(1, len(out) + 1)})

    return rows.select("query_id", "text_id", "kind", "priority", "tokens", T.trigrams(F.col("content")).alias("grams")).groupBy("query_id").applyInPandas(choose, "query_id long, text_id long, rank int")
