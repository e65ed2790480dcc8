"""Rollups and windows over behaviour, memories and facts. All pre-aggregate before their shuffle; ties are broken by id.

Windows over a key's time order are Spark windows, which spill; replays that need a state of fixed size take one pass over rows in
order and hold only that state, so a key of any history needs no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mnemoframe.functions import text as T


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def activation_mass(memories: DataFrame, activation: Column) -> DataFrame:
    """(term, awdf): sum of the base activation of the rows that hold the term."""
    return memories.select(activation.alias("a"), F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.sum("a").alias("awdf"))


def graduated(pairs: DataFrame, frequencies: DataFrame, total: DataFrame, least_count: int = 5, least_pmi: float = 3.0, most_share: float = 0.3, most_fan: int = 50) -> DataFrame:
    """Word pairs strong enough for the synonym table. pairs: (w1, w2, n, pmi), w1 < w2; frequencies: (term, df); total: one row (total)."""
    both = pairs.select("w1").unionAll(pairs.select("w2")).groupBy(F.col("w1").alias("term")).agg(F.count("*").alias("fan"))
    side = frequencies.join(both, "term").select("term", "df", "fan")
    strong = pairs.where((F.col("n") >= least_count) & (F.col("pmi") > least_pmi))
    rows = strong.join(side.select(F.col("term").alias("w1"), F.col("df").alias("d1"), F.col("fan").alias("f1")), "w1").join(side.select(F.col("term").alias("w2"), F.col("df").alias("d2"), F.col("fan").alias("f2")), "w2").join(F.broadcast(total))
    share = F.col("total") * most_share
    return rows.where((F.col("d1") <= share) & (F.col("d2") <= share) & ~((F.col("f1") > most_fan) & (F.col("f2") > most_fan))).select("w1", "w2", "n", "pmi")


def knowledge_decay(domains: DataFrame) -> DataFrame:
    """(domain, confidence, half_life, trend) of (domain, total, quality_sum, corrections, days_since)."""
    n = F.col("total")
    quality = F.when(n > 0, F.col("quality_sum") / n).otherwise(5.0)
    rate = F.when(n > 0, (F.col("corrections") + 1) / (n + 2)).otherwise(0.0)
    half = F.greatest(F.lit(3.0), 30 * (1 - rate))
    days = F.coalesce("days_since", F.lit(999.0))
    decay = F.when(rate > 0, 0.3 * F.exp(-days / half)).otherwise(0.0)
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(0.95), (1 - decay) / (1 + F.exp(-0.8 * (quality - 5)))))
    trend = F.when((n >= 5) & (days < 3), "degrading").when((n >= 5) & (days > 14) & (rate < 0.1), "improving").otherwise("stable")
    return domains.select("domain", F.round(confidence, 6).alias("confidence"), F.round(half, 6).alias("half_life"), trend.alias("trend"))


def weak_domains(domains: DataFrame) -> DataFrame:
    """Domains with five answers or more whose correction rate is over 10 % or whose mean quality is under 5, by falling rate."""
    rate = F.round(100 * (F.col("corrections") + 1) / (F.col("total") + 2), 1)
    quality = F.round(F.col("quality_sum") / F.col("total"), 1)
    return domains.where("total >= 5").select("domain", rate.alias("rate"), quality.alias("quality")).where("rate > 10 or quality < 5").orderBy(F.desc("rate"), "domain")


def mood_state(moods: DataFrame, now: Column) -> DataFrame:
    """Per user: means of the last 24 hours (of two rows or more), low days among the last three, shares of the last 50 rows."""
    day = moods.where(F.col("ts") > now - F.expr("interval 3 days")).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("mood").alias("m")).groupBy("user_id").agg(F.count(F.when(F.col("m") < -0.3, 1)).alias("low_days"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = F.col("ts") > now - F.expr("interval 24 hours")
    rows = moods.withColumn("_r", rank).groupBy("user_id").agg(
        F.when(F.count(F.when(recent, 1)) >= 2, F.avg(F.when(recent, F.col("mood")))).alias("mean_24h"),
        F.count(F.when((F.col("_r") <= 50) & (F.col("mood") > 0.3), 1)).alias("positive"), F.count(F.when((F.col("_r") <= 50) & (F.col("mood") < -0.3), 1)).alias("negative"), F.least(F.count("*"), F.lit(50)).alias("total"),
    )
    return rows.join(day, "user_id", "left").select("user_id", F.round("mean_24h", 6).alias("mean_24h"), F.coalesce("low_days", F.lit(0)).alias("low_days"), "positive", "negative", "total")


def learned_styles(observations: DataFrame) -> DataFrame:
    """(slot, topic, mood, style, hits, misses) of situations seen three times or more with 40 % of hits or more.

    The style is that of the first hit, or of the first observation. observations: (slot, topic, mood, style, satisfied, ts, event_id).
    """
    first = F.min_by("style", F.struct((~F.col("satisfied")).alias("miss"), "ts", "event_id"))
    rows = observations.groupBy("slot", "topic", "mood").agg(first.alias("style"), F.count(F.when(F.col("satisfied"), 1)).alias("hits"), F.count(F.when(~F.col("satisfied"), 1)).alias("misses"))
    return rows.where((F.col("hits") + F.col("misses") >= 3) & (F.col("hits") >= 0.4 * (F.col("hits") + F.col("misses"))))


def insight_rules(memories: DataFrame, days: float = 7) -> DataFrame:
    """(rule, n): the leading scope of the last days with five rows or more, three painful rows or more, three corrections or more."""
    recent = memories.where((F.col("age_days") <= days) & ~F.col("scope").isin("expired", "insight"))
    top = recent.groupBy("scope").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope").limit(1).where("n >= 5").select(F.concat(F.lit("scope:"), "scope").alias("rule"), "n")
    totals = recent.agg(F.count(F.when(F.col("emotion") == "painful", 1)).alias("painful"), F.count(F.when(F.col("scope") == "correction", 1)).alias("correction"))
    return top.unionAll(totals.select(F.explode(F.expr("map('painful', painful, 'correction', correction)"))).toDF("rule", "n").where("n >= 3"))


def _rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do it, by its multiple: F.round goes by its decimal digits and parts from them at halves, as of 1.005."""
    return F.round(x * 10**digits) / 10**digits


def growth(rows: DataFrame, now: Column) -> DataFrame:
    """This week against the last per user: correction rate and mean value with their trends. rows: (user_id, ts, corrected, value)."""
    this, last = (F.col("ts") > now - F.expr("interval 7 days")), (F.col("ts") > now - F.expr("interval 14 days")) & (F.col("ts") <= now - F.expr("interval 7 days"))
    rate = lambda w: F.count(F.when(w & F.col("corrected"), 1)) / F.greatest(F.lit(1), F.count(F.when(w, 1)))
    got = rows.groupBy("user_id").agg(rate(this).alias("rate"), rate(last).alias("before"), F.avg(F.when(this, F.col("value"))).alias("mean"), F.avg(F.when(last, F.col("value"))).alias("mean_before"))
    trend = F.when(F.col("rate") < F.col("before") - 0.02, "up").when(F.col("rate") > F.col("before") + 0.02, "down").otherwise("stable")
    quality = F.when(F.col("mean") > F.col("mean_before") + 0.03, "up").when(F.col("mean") < F.col("mean_before") - 0.03, "down").otherwise("stable")
    return got.select("user_id", _rounded(100 * F.col("rate"), 1).alias("rate"), trend.alias("trend"), _rounded(F.col("mean"), 2).alias("mean"), F.when(F.col("mean").isNotNull(), quality).alias("quality_trend"))


def pair_quality(rows: DataFrame, group: str, item: str, quality: str, least: int = 3) -> DataFrame:
    """(a, b, n, quality): items that meet in a group, with the groups' mean quality. One row per group and item enters the pairing."""
    sets = rows.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("items"), F.avg(quality).alias("q")).where(F.size("items") > 1)
    pairs = sets.select("q", F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.filter("items", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.avg("q").alias("quality")).where(F.col("n") >= least)


def moving_prediction(states: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """For each state the forecast of the next by the last three, weighted .5, .3 and .2 from the oldest, and its confidence."""
    w = Window.partitionBy(by).orderBy(*order)
    three = F.collect_list(value).over(w.rowsBetween(-2, 0))
    rows = states.withColumn("_v", three).where(F.size("_v") >= 2)
    weights = F.array(*[F.lit(x) for x in (0.5, 0.3, 0.2)])
    total = F.aggregate(F.zip_with("_v", F.slice(weights, 1, F.size("_v")), lambda v, x: v * x), F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate(F.slice(weights, 1, F.size("_v")), F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v")
    rows = rows.withColumn("_m", mean)
    variance = F.aggregate(F.transform("_v", lambda v: (v - F.col("_m")) * (v - F.col("_m"))), F.lit(0.0), lambda a, x: a + x) / F.size("_v")
    return rows.select(by, *[c for c in order if c != by], F.round(total / norm, 6).alias("predicted"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.9), 1 - 4 * variance)), 6).alias("confidence"))


def frustration(turns: DataFrame, by: str, order: str, negative: Column) -> DataFrame:
    """(by, order, signal, level): the turn's signal and its decaying sum over the last 50 turns. turns: text and the two keys."""
    w = Window.partitionBy(by).orderBy(order)
    rows = turns.select(by, order, F.length("text").alias("n"), F.coalesce(F.lag(F.length("text")).over(w), F.lit(0)).alias("before"), F.row_number().over(w).alias("k"), F.col("text").rlike("[?？]").alias("asks"), negative.alias("bad"))
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    signal = (
        add((F.col("before") > 0) & (F.col("n") < 0.5 * F.col("before")), 0.2) + add(F.col("asks") & (F.col("k") > 3), 0.15) + add(F.col("bad"), 0.3) + F.least(F.lit(0.15), 0.02 * F.col("k"))
        - add(F.col("n") > 1.2 * F.col("before"), 0.15) - add(~F.col("asks") & ~F.col("bad"), 0.05)
    )
    rows = rows.withColumn("signal", F.greatest(F.lit(-0.2), F.least(F.lit(0.5), signal)))
    last = F.collect_list("signal").over(w.rowsBetween(-49, 0))
    level = F.aggregate(last, F.lit(0.0), lambda a, x: 0.7 * a + x)
    return rows.select(by, order, F.round("signal", 6).alias("signal"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)), 6).alias("level"))


def folded(rows: DataFrame, by: str, order: list[str], values: list[str], start: float, step, name: str) -> DataFrame:
    """Adds ``name``: a state of each key after every row, folded in order by ``step(state, *values)`` with only the state held."""
    columns = rows.columns
    at, key_at = [columns.index(c) for c in values], columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for batch in batches:
            out = []
            for k, *xs in zip(batch.column(key_at).to_pylist(), *(batch.column(i).to_pylist() for i in at)):
                if k != key:
                    key, state = k, start
                state = step(state, *xs)
                out.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*columns, name])

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def response_delay(events: DataFrame) -> DataFrame:
    """(user_id, event_id, delay): running mean, .9 of the old and .1 of the new, of gaps under an hour in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros("ts") / 1e6 - F.lag(micros("ts") / 1e6).over(w)
    return folded(events.select("user_id", "event_id", "ts", gap.alias("gap")), "user_id", ["ts", "event_id"], ["gap"], 0.0, lambda s, g: s if g is None or g >= 3600 else 0.9 * s + 0.1 * g, "delay").select("user_id", "event_id", F.round("delay", 4).alias("delay"))


def co_written(memories: DataFrame, top: DataFrame, seconds: int = 5) -> DataFrame:
    """(event_id): rows written within ``seconds`` of a chosen row, found by equal or neighbouring time buckets, not by all pairs."""
    cell = F.floor(micros("ts") / (1e6 * seconds)).cast("long")
    chosen = top.select(F.col("event_id").alias("_id"), micros("ts").alias("_t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = memories.withColumn("cell", cell).join(chosen, "cell").where((F.abs(micros("ts") - F.col("_t")) < 1_000_000 * seconds) & (F.col("event_id") != F.col("_id")))
    return near.select("event_id").distinct()


def say_do_gap(intents: DataFrame, events: DataFrame, least: int = 5, share: float = 0.3) -> DataFrame:
    """(user_id, n, late): users whose share of events in the small hours after their first intent is over ``share``."""
    first = intents.groupBy("user_id").agg(F.min("ts").alias("since"))
    after = events.join(first, "user_id").where(F.col("ts") > F.col("since"))
    got = after.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.hour("ts") < 5, 1)).alias("late"))
    return got.where((F.col("n") > least) & (F.col("late") > share * F.col("n")))


def contradictions(memories: DataFrame, flip, each: int = 10) -> DataFrame:
    """(newer, older): rows among each scope's newest ``each`` that contradict one of the next ``each``. flip(a, b): condition."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("age_days", "memory_id"))
    rows = memories.withColumn("_r", rank).where(F.col("_r") <= 2 * each).select("scope", "memory_id", "content", "_r")
    a = rows.where(F.col("_r") <= each).select("scope", F.col("memory_id").alias("newer"), F.col("content").alias("ca"))
    b = rows.where(F.col("_r") > each).select("scope", F.col("memory_id").alias("older"), F.col("content").alias("cb"))
    return a.join(b, "scope").where(flip(F.col("ca"), F.col("cb"))).select("newer", "older")


def trimmed_history(turns: DataFrame, by: str, order: str, keep: int, with_first: bool) -> DataFrame:
    """The last ``keep`` turns of each key; with the first one and the last keep - 1 in the extreme tier."""
    down, up = (F.row_number().over(Window.partitionBy(by).orderBy(o)) for o in (F.desc(order), F.asc(order)))
    rows = turns.withColumn("_d", down).withColumn("_u", up)
    return rows.where(((F.col("_d") < keep) | (F.col("_u") == 1)) if with_first else F.col("_d") <= keep).drop("_d", "_u")


def recommended(memories: DataFrame, stability: float = 30, most: int = 3) -> DataFrame:
    """Important rows about to be forgotten, by urgency times importance."""
    r = 1 / (1 + F.col("age_days") / (9 * stability))
    rows = memories.where(~F.col("scope").isin("expired", "decayed", "consolidated") & (F.col("importance") >= 6)).withColumn("r", r).where("r between 0.3 and 0.6")
    return rows.select("memory_id", F.round((0.6 - F.col("r")) / 0.3, 6).alias("urgency"), "importance").orderBy(F.desc(F.col("urgency") * F.col("importance")), "memory_id").limit(most)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, those of least hash of key and seed: the same on every run and any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def promotions(memories: DataFrame) -> DataFrame:
    """(memory_id, score): rows that engagement, value and stability make core memories. Needs engaged_count and miss_count."""
    rate = F.col("engaged_count") / F.greatest(F.lit(1), F.col("engaged_count") + F.col("miss_count"))
    engaged = F.when((rate > 0.6) & (F.col("engaged_count") >= 5), 1.0).otherwise(0.0)
    value = F.least(F.lit(1.0), F.when(F.col("emotion").isin("important", "warm"), 0.5).otherwise(0.0) + F.when(F.col("recall_count") >= 3, 0.5).otherwise(0.0) + F.when(F.col("scope").isin("preference", "fact"), 0.3).otherwise(0.0))
    stable = F.when((F.col("recall_count") / F.greatest(F.lit(1.0), F.col("age_days")) > 0.5) & (F.col("stability") > 10), 1.0).otherwise(0.0)
    score = 0.4 * engaged + 0.3 * value + 0.3 * stable
    return memories.where(~F.col("scope").isin("expired", "decayed", "core_memory")).select("memory_id", F.round(score, 6).alias("score")).where("score > 0.5")


def decayed_pairs(pairs: DataFrame) -> DataFrame:
    """Co-occurrence counts after one decay; pairs that fall under one half go."""
    return pairs.withColumn("n", F.col("n") * F.when(F.col("n") > 10, 0.995).otherwise(0.98)).where("n >= 0.5")


def phrase_score(tokens: list[str], content: Column) -> Column:
    """Two-word and three-word runs of a query found in a content: hits (three words count twice) over runs."""
    low = F.lower(content)
    two = [(f"{a} {b}", a + b) for a, b in zip(tokens, tokens[1:])]
    three = [" ".join(x) for x in zip(tokens, tokens[1:], tokens[2:])]
    if not two:
        return F.lit(0.0)
    hits = sum([(F.contains(low, F.lit(x)) | F.contains(low, F.lit(y))).cast("int") for x, y in two], F.lit(0)) + sum([2 * F.contains(low, F.lit(x)).cast("int") for x in three], F.lit(0))
    return hits / float(len(two) + len(three))


def strengths(comparisons: DataFrame, by: str, order: list[str], rate: float = 0.1) -> DataFrame:
    """(by, item, strength): Bradley-Terry strengths of each key's items after its comparisons (winner, loser) in order.

    A key's comparisons pass in order with only its items' strengths held.
    """
    columns = [by, "winner", "loser"]
    schema = StructType([comparisons.schema[by], StructField("item", comparisons.schema["winner"].dataType), StructField("strength", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        held: dict = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({by: [key] * len(held), "item": list(held), "strength": list(held.values())})

        for batch in batches:
            for k, winner, loser in zip(*(batch.column(c).to_pylist() for c in columns)):
                if k != key:
                    if held:
                        yield told()
                    key, held = k, {}
                a, b = held.get(winner, 1.0), held.get(loser, 1.0)
                surprise = b / (a + b)
                held[winner], held[loser] = a * (1 + rate * surprise), b * (1 - rate * (1 - surprise))
                if (total := sum(held.values())) > 100:
                    held = {x: v / total * len(held) for x, v in held.items()}
        if held:
            yield told()

    return comparisons.select(*columns, *order).repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
