"""Replays and similarities of a user's wording. Replays hold one key's fixed-size state, never its history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mnemoframe.functions import text as T


def replayed(rows: DataFrame, by: str, order: list[str], value: str, start: tuple[float, ...], step: Callable, names: list[str]) -> DataFrame:
    """(by, order, names): the state of each key after every row, folded in order by ``step(state, value)``; value is an array."""
    rows = rows.select(by, *order, value)
    keys = [by, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for batch in batches:
            states = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(len(keys)).to_pylist()):
                if k != key:
                    key, state = k, start
                state = step(state, v)
                states.append(state)
            columns = [pa.array([s[i] for s in states], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, *names])

    schema = StructType([*[rows.schema[c] for c in keys], *[StructField(n, DoubleType()) for n in names]])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


PRESSURE = ["frustration", "signal", "stress", "velocity", "coupling"]


def pressure(rows: DataFrame, by: str, order: list[str], start_coupling: float = 0.3) -> DataFrame:
    """Frustration and stress that feed each other, after every row. rows: by, order and drive (array of signal and force)."""
    clip = lambda x, lo, hi: max(lo, min(hi, x))

    def step(state: tuple, drive: list[float]) -> tuple:
        f, _, s, v, c = state
        signal = drive[0] * (1 + s * c)
        f = clip(0.9 * f + 0.3 * signal, 0.0, 1.0)
        v += -0.15 * s + drive[1] + 0.1 * f * c - 0.3 * v
        s = clip(s + v, 0.0, 1.0)
        c = min(1.0, c + 0.05) if f > 0.5 and s > 0.5 else max(0.1, 0.99 * c)
        return f, signal, s, clip(v, -0.5, 0.5), c

    return replayed(rows, by, order, "drive", (0.0, 0.0, 0.0, 0.0, start_coupling), step, PRESSURE)


def pressure_phase(f: Column, signal: Column, s: Column, v: Column) -> Column:
    top = F.greatest(f, s)
    return F.when(top > 0.7, "critical").when((top > 0.4) & ((signal > 0) | (v > 0)), "building").when((top > 0.3) & (v < -0.05), "recovering").otherwise("calm")


def turns_to_breakdown(f: Column, signal: Column, s: Column, v: Column) -> Column:
    """Turns until pressure reaches 0.8 at the present speed: 0 when critical, null when slow, low, past it or over ten turns away."""
    top, speed = F.greatest(f, s), F.greatest(signal, v)
    turns = F.ceil((0.8 - top) / speed)
    return F.when(top > 0.7, F.lit(0)).when((speed > 0.03) & (top > 0.3) & turns.between(0, 10), turns)


def style_preference(rows: DataFrame, by: str, order: list[str], names: list[str], start: tuple[float, ...] = (0.5, 0.3, 0.3, 0.5, 0.5)) -> DataFrame:
    """A user's preferred style after every reply. rows: by, order and reply (array: the style vector, then 1 if liked, else -1)."""

    def step(state: tuple, reply: list[float]) -> tuple:
        rate = (0.2 if state[-1] < 20 else 0.05) * reply[-1]
        return *(max(0.0, min(1.0, x + rate * (r - x))) for x, r in zip(state[:-1], reply)), state[-1] + 1

    return replayed(rows, by, order, "reply", (*start, 0.0), step, [*names, "samples"])


def pace(turns: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, mean_length, per_minute, speed) from the five turns before each. turns: by, order, text and ts."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-5, -1)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    got = turns.select(by, order, F.length("text").alias("own"), F.count("text").over(w).alias("n"), F.avg(F.length("text")).over(w).alias("mean"), F.first(seconds, True).over(w).alias("a"), F.last(seconds, True).over(w).alias("b"), F.count("ts").over(w).alias("k"))
    rate = F.when((F.col("n") >= 2) & (F.col("k") >= 2), F.col("k") / F.greatest((F.col("b") - F.col("a")) / 60, F.lit(0.5))).otherwise(0.0)
    got = got.select(by, order, "n", F.when(F.col("n") < 2, F.col("own")).otherwise(F.col("mean")).alias("mean_length"), rate.alias("per_minute"))
    fast = (F.col("n") >= 3) & ((F.col("per_minute") > 3) | ((F.col("per_minute") > 1) & (F.col("mean_length") < 20)))
    slow = (F.col("per_minute") > 0) & (F.col("per_minute") < 0.3) & (F.col("mean_length") > 100)
    return got.select(by, order, F.round("mean_length", 4).alias("mean_length"), F.round("per_minute", 4).alias("per_minute"), F.when(fast, "rapid").when(slow, "slow").otherwise("normal").alias("speed"))


def weighted_similarity(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, similarity): trigram Jaccard with weights, 1 for trigrams without one. pairs: (id, a, b); weights: (gram, weight)."""
    sets = pairs.select("id", T.trigrams(F.col("a")).alias("a"), T.trigrams(F.col("b")).alias("b"))
    each = sets.where("size(a) > 0 and size(b) > 0").select("id", F.explode(F.concat(F.transform(F.array_intersect("a", "b"), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("both"))), F.transform(F.array_except(F.array_union("a", "b"), F.array_intersect("a", "b")), lambda g: F.struct(g.alias("gram"), F.lit(False).alias("both"))))).alias("g")).select("id", "g.*")
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    sums = each.join(weights, "gram", "left").groupBy("id").agg((F.sum(F.when(F.col("both"), w).otherwise(0.0)) / F.sum(w)).alias("similarity"))
    return pairs.select("id").join(sums, "id", "left").select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def topics_for(queries: DataFrame, topics: DataFrame, least: float = 0.2, most: int = 5) -> DataFrame:
    """(query_id, topic_id, overlap): the ``most`` topics whose keywords overlap best, ties by id. Both: (id, text)."""
    words = lambda df, name: df.select(F.col("id").alias(name), F.array_distinct(F.transform(T.pattern_words(F.col("text"), "cjk2_en3"), F.lower)).alias("ws")).select(name, F.size("ws").alias(f"{name}_n"), F.explode("ws").alias("word"))
    hits = words(queries, "query_id").join(words(topics, "topic_id"), "word").groupBy("query_id", "topic_id", "query_id_n", "topic_id_n").agg(F.count("*").alias("hits"))
    rated = hits.select("query_id", "topic_id", (F.col("hits") / F.least("query_id_n", "topic_id_n")).alias("overlap")).where(F.col("overlap") >= least)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "topic_id"))
    return rated.withColumn("_rank", best).where(F.col("_rank") <= most).drop("_rank")
