"""Graph walks over (source, target, weight) edges, as joins in a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.sources.shared import cut, stored

# Weights of relation types.
TYPE_WEIGHTS = {"caused_by": 1.5, "depends_on": 1.3, "contradicts": 0.5, "uses": 1.0, "works_at": 1.0, "knows": 0.8, "part_of": 0.9, "related_to": 0.7, "follows": 0.6, "prefers_over": 1.1, "triggers": 1.2, "learned_from": 1.3}


# Relations that lead to a cause, and to an effect; confidence of a relation that states none.
CAUSES, EFFECTS, CONFIDENCE = ("caused_by", "depends_on", "learned_from"), ("triggers", "leads_to"), 0.7


def type_weight(default: float) -> Column:
    by_type = F.lit(default)
    for k, v in TYPE_WEIGHTS.items():
        by_type = F.when(F.col("type") == k, v).otherwise(by_type)
    return by_type


def edge_weight(default: float = 0.8) -> Column:
    """Weight times the type's weight times the pull of recent edges, of (type, weight, age_days)."""
    return F.coalesce("weight", F.lit(1.0)) * type_weight(default) * F.greatest(F.lit(0.3), F.exp(-F.col("age_days") / 90))


def active_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Valid edges of which both ends are valid entities. edges: (source, target, invalid and others); entities: (name, invalid)."""
    live = entities.where(~F.coalesce("invalid", F.lit(False))).select("name").distinct()
    out = edges.where(~F.coalesce("invalid", F.lit(False)))
    return out.join(live.withColumnRenamed("name", "source"), "source", "left_semi").join(live.withColumnRenamed("name", "target"), "target", "left_semi")


def rank_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, weight) for ``personalized_pagerank``: weight, confidence, type and recency of active edges."""
    return active_edges(edges, entities).select("source", "target", (edge_weight() * F.coalesce("confidence", F.lit(CONFIDENCE))).alias("weight"))


def breadth_first(step: DataFrame, start: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """(node, hop, path, value) in the order of a breadth-first walk: by hop, then path. step: (here, there, ord, value), ord unique.

    A node is reached over the first edge in the order of the walk: that of its earliest neighbour, of its edges the least ``ord``. The
    edges' ords from the start are its path, and paths of one hop compare as their nodes are reached. With ``most`` the walk ends after so
    many nodes, and frontiers are bounded by it.
    """
    seen = cut(start.select("node").distinct().select("node", F.lit(0).alias("hop"), F.array().cast("array<long>").alias("path"), F.lit(None).cast("double").alias("value")))
    front, left = seen, most
    for hop in range(1, hops + 1):
        edge = F.struct(F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"), step["value"].cast("double").alias("value"))
        near = front.select("node", "path").join(step, F.col("node") == F.col("here")).groupBy(F.col("there").alias("node")).agg(F.min(edge).alias("e")).select("node", F.lit(hop).alias("hop"), "e.path", "e.value")
        fresh = near.join(seen.select("node"), "node", "left_anti")
        front = cut(fresh if left is None else fresh.orderBy("path").limit(left))
        seen = seen.unionByName(front)
        if left is not None:
            left -= front.count()
            if left <= 0:
                break
    return seen.where("hop > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    """(here, there, ord) over valid edges in either direction; an edge from a node to itself once."""
    live = edges.where(~F.coalesce("invalid", F.lit(False)))
    one = live.select(F.col("source").alias("here"), F.col("target").alias("there"), "ord")
    return one.unionAll(live.where("source <> target").select("target", "source", "ord"))


def walk_memories(edges: DataFrame, start: DataFrame, index: DataFrame, memories: DataFrame, hops: int = 2, most: int = 10) -> DataFrame:
    """(memory_id): the first ``most`` live memories that mention one of the first ``most`` entities around the start. index: (name, memory_id)."""
    walked = breadth_first(both_ways(edges).withColumn("value", F.lit(None).cast("double")), start, hops, most)
    live = memories.where(~F.col("scope").isin("expired", "decayed")).select("memory_id")
    return index.join(walked.select(F.col("node").alias("name")), "name", "left_semi").select("memory_id").distinct().join(live, "memory_id", "left_semi").orderBy("memory_id").limit(most)


def weighted_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 10) -> DataFrame:
    """(node, hop, weight): nodes over valid undirected edges, the heaviest edges first, at most ``most`` over all hops.

    Every hop keeps what is left of ``most`` by weight, so frontiers are bounded. Ties go by node.
    """
    live = edges.where("not invalid").withColumn("w", edge_weight())
    both = live.select("source", "target", "w").unionAll(live.select(F.col("target"), F.col("source"), "w"))
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(0.0).alias("weight"))
    front, left = seen, most
    for hop in range(1, hops + 1):
        near = both.join(F.broadcast(front.select(F.col("node").alias("source"))), "source").groupBy(F.col("target").alias("node")).agg(F.max("w").alias("weight"))  # a frontier has at most ``most`` rows
        front = cut(near.join(seen.select("node"), "node", "left_anti").orderBy(F.desc("weight"), "node").limit(left).select("node", F.lit(hop).alias("hop"), "weight"))
        left -= front.count()
        seen = seen.unionByName(front)
        if left <= 0:
            break
    return seen.where("hop > 0")


def mentioning(index: DataFrame, nodes: DataFrame, score: Column, most: int, digits: int = 6) -> DataFrame:
    """(memory_id, score): memories of an inverted index (name, memory_id) by the summed score of their entities."""
    hits = index.join(nodes.select(F.col("node").alias("name"), score.alias("s")), "name")
    return hits.groupBy("memory_id").agg(F.round(F.sum("s"), digits).alias("score")).orderBy(F.desc("score"), "memory_id").limit(most)


def entity_rank(entities: DataFrame) -> DataFrame:
    """(name, rank): mentions, fading with 30 days of idleness, more for active ones."""
    mass = F.col("mentions") * F.exp(-F.col("idle_days") / 30) * (1 + 0.5 * F.coalesce("activation", F.lit(0.0)))
    return entities.where("not invalid").select("name", F.round(F.greatest(F.lit(0.01), mass), 6).alias("rank"))


def causal_chain(edges: DataFrame, start: DataFrame, up: bool, hops: int = 3) -> DataFrame:
    """(node, hop, type, strength): what causes the start (up: over edges into it) or what it leads to; a node by the first edge that reaches it.

    strength: the edge's confidence times its weight over the hop. edges: (source, target, type, weight, confidence, invalid, ord).
    """
    live = edges.where(~F.coalesce("invalid", F.lit(False)) & F.col("type").isin(*(CAUSES if up else EFFECTS)))
    step = live.select(F.col("target" if up else "source").alias("here"), F.col("source" if up else "target").alias("there"), "ord", (F.coalesce("confidence", F.lit(CONFIDENCE)) * F.coalesce("weight", F.lit(1.0))).alias("value"))
    walked = breadth_first(step, start, hops)
    types = live.select(F.col("ord").alias("_ord"), "type")
    return walked.join(types, F.element_at("path", -1) == F.col("_ord")).select("node", "hop", "type", (F.col("value") / F.col("hop")).alias("strength"))


def missing_causes(mentions: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(source, target): cause and effect entities of one memory without an edge between them yet. mentions: (memory_id, cause, effect)."""
    pairs = mentions.where("cause <> effect").groupBy(F.col("cause").alias("source"), F.col("effect").alias("target")).agg(F.count("*").alias("n"))
    return pairs.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti").orderBy(F.desc("n"), "source", "target").limit(most)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of (a, b) edges: the least node reachable. Labels fall to the least of the neighbours', then to their
    label's label; each round is stored, and the loop ends when none changed."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    now = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(most_rounds):
        heard = both.join(now, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        least = now.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = stored(least.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        done = not following.where("old <> label").take(1)
        now = following.select("node", "label")
        if done:
            return now.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes reached over undirected edges, each with its least hop."""
    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(both, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 20, store_every: int = 5) -> DataFrame:
    """(node, rank): teleport to the seeds, out-weights normalised, mass of nodes without edges lost. seeds: (node), few."""
    share = cut(edges.where("weight > 0").groupBy("source", "target").agg(F.sum("weight").alias("weight")).join(edges.where("weight > 0").groupBy("source").agg(F.sum("weight").alias("total")), "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("node").distinct()
    n = start.count()
    base = start.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    now = base
    for step in range(rounds):
        if step and step % store_every == 0:
            now = cut(now)
        walked = now.join(share, F.col("node") == F.col("source")).select(F.col("target").alias("node"), ((1 - alpha) * F.col("rank") * F.col("share")).alias("rank"))
        now = walked.unionByName(base.select("node", (alpha * F.col("rank")).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank"))
    return now


def spreading(edges: DataFrame, seeds: DataFrame, rounds: int = 3, decay: float = 0.5, least: float = 0.01) -> DataFrame:
    """(node, activation): seeds hold 1; every round each node of at least ``least`` passes on decay * weight * type weight of all it holds
    over valid edges in either direction; activations add up. edges: (source, target, type, weight, invalid)."""
    live = edges.where(~F.coalesce("invalid", F.lit(False))).select("source", "target", (F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")) * type_weight(0.7)).alias("w"))
    ends = live.unionAll(live.where("source <> target").select("target", "source", "w")).groupBy("source", "target").agg(F.sum("w").alias("w"))
    total = seeds.select("node").distinct().withColumn("activation", F.lit(1.0))
    for _ in range(rounds):
        spread = total.where(F.col("activation") >= least).join(ends, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (decay * F.col("activation") * F.col("w")).alias("activation"))
        total = total.unionByName(spread).groupBy("node").agg(F.sum("activation").alias("activation"))
    return total
