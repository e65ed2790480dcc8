"""The memory store: lookups, fact and chat scans, upserts, soft invalidation, trims, candidate pruning and trigger matches.

All operators return DataFrames. Ties are broken by id; rows with a null in a compared column take part as SQL has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from mnemoframe.operators.mentions import occurrences


def find_by_content(memories: DataFrame, content: str) -> DataFrame:
    """The live row of least id with exactly this content."""
    return memories.where((F.col("content") == content) & (F.col("scope") != "expired")).orderBy("memory_id").limit(1)


def find_facts(facts: DataFrame, subject: str | None = None, predicate: str | None = None, part_of_object: str | None = None, valid_only: bool = True) -> DataFrame:
    """Facts by any of subject, predicate and a part of the object; open ones unless ``valid_only`` is off. Needs valid_until."""
    wanted = [F.col("subject") == subject if subject is not None else None, F.col("predicate") == predicate if predicate is not None else None, F.contains("object", F.lit(part_of_object)) if part_of_object is not None else None, F.col("valid_until").isNull() if valid_only else None]
    return facts.where(reduce(lambda a, b: a & b, [w for w in wanted if w is not None], F.lit(True)))


def latest(rows: DataFrame, order: list[Column], limit: int = 30) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def hub_upload(rows: DataFrame, hub: DataFrame, content: str, columns: list[str]) -> DataFrame:
    """Rows the hub lacks, one for each content hash (the row first by ``columns``). Hash: first 16 hex digits of SHA-256."""
    hashed = rows.withColumn("content_hash", F.substring(F.sha2(F.col(content), 256), 1, 16))
    first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("content_hash").orderBy(*columns))).where("_r = 1").drop("_r")
    return first.join(hub.select("content_hash").distinct(), "content_hash", "left_anti")


def hub_download(hub: DataFrame, me: int, since: float, limit: int = 1000) -> DataFrame:
    return hub.where((F.col("received_at") >= since) & (F.col("instance") != me)).orderBy("received_at", "content_hash").limit(limit)


def keyword_search(memories: DataFrame, keywords: list[str], limit: int = 10) -> DataFrame:
    """Share of keywords in the content times a scope boost; archived rows count 0.3."""
    found = reduce(lambda a, b: a + b, [F.contains(F.lower("content"), F.lit(w)).cast("int") for w in keywords])
    boost = F.when(F.col("scope") == "archived", 0.3).when(F.col("scope") == "correction", 1.5).when(F.col("scope").isin("fact", "preference"), 1.3).otherwise(1.0)
    return memories.select("memory_id", F.round(found / len(keywords) * boost, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "memory_id").limit(limit)


# Predicates that may hold several objects at a time.
OPEN_PREDICATES = ("learning", "likes", "dislikes", "habit", "prefers")


def superseded(facts: DataFrame, open_predicates: tuple[str, ...] = OPEN_PREDICATES) -> DataFrame:
    """A history of writes as versions: adds written (false for skipped writes) and valid_until.

    In order of ts and fact_id, by subject and predicate: an exact repetition of an open fact is skipped; an object less than half
    as long as an open one of no less confidence is skipped; facts of open predicates are added beside the others; any other fact
    closes the open one. Of an open predicate the first write of each object counts, and its distinct objects are held.
    """
    columns = facts.columns
    at = [columns.index(c) for c in ("subject", "predicate", "object", "confidence")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, trust, seen = None, None, 0.0, set()
        for batch in batches:
            written = []
            for subject, predicate, value, confidence in zip(*(batch.column(k).to_pylist() for k in at)):
                if (subject, predicate) != key:
                    key, held, seen = (subject, predicate), None, set()
                if predicate in open_predicates:
                    keep = value not in seen
                    seen.add(value)
                else:
                    keep = held is None or (value is not None and value != held and not (len(value) < 0.5 * len(held) and (trust or 0) >= (confidence or 0)))
                    if keep:
                        held, trust = value, confidence
                written.append(keep)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(written, pa.bool_())], names=[*columns, "written"])

    # one key's writes pass in their order with only its state held: a history of any length needs no more memory
    ordered = facts.repartition("subject", "predicate").sortWithinPartitions("subject", "predicate", "ts", "fact_id")
    told = ordered.mapInArrow(run, StructType([*facts.schema.fields, StructField("written", BooleanType())]))
    closes = F.col("written") & ~F.col("predicate").isin(*open_predicates)
    following = F.lead("ts").over(Window.partitionBy("subject", "predicate", closes).orderBy("ts", "fact_id"))
    return told.withColumn("valid_until", F.when(closes, following))


def trimmed_chat(turns: DataFrame, by: str, order: str, keep: int = 100, user_chars: int = 1000, other_chars: int = 2000) -> DataFrame:
    """The newest turns of each key, texts cut to what is stored."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    text = F.when(F.col("role") == "user", F.substring("text", 1, user_chars)).otherwise(F.substring("text", 1, other_chars))
    return turns.withColumn("_r", rank).where(F.col("_r") <= keep).withColumn("text", text).drop("_r")


def without_long_expired(memories: DataFrame, days: int = 30) -> DataFrame:
    return memories.where(~((F.col("scope") == "expired") & (F.col("age_days") > days)))


def upserted_entities(base: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, mentions, attrs, invalid): mentions add up, attrs are merged and sorted, an entity seen again is valid.

    base: (name, mentions, attrs, invalid); seen: (name, attr). Sums are taken before the join, so a hot name is one row there.
    """
    new = seen.groupBy("name").agg(F.count("*").alias("_n"), F.collect_set("attr").alias("_attrs"))
    none = F.array().cast("array<string>")
    return base.join(new, "name", "full").select(
        "name", (F.coalesce("mentions", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("mentions"),
        F.sort_array(F.array_union(F.coalesce("attrs", none), F.coalesce("_attrs", none))).alias("attrs"), (F.coalesce("invalid", F.lit(False)) & F.col("_n").isNull()).alias("invalid"),
    )


def invalidated(entities: DataFrame, edges: DataFrame, stale_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Entities with at most one mention and idle for ``stale_days`` become invalid, and so do all their edges and idle edges."""
    now = entities.withColumn("invalid", F.col("invalid") | ((F.col("idle_days") > stale_days) & (F.col("mentions") <= 1)))
    gone = now.where("invalid").select("name")
    ends = edges.join(gone.select(F.col("name").alias("source"), F.lit(True).alias("_s")), "source", "left").join(gone.select(F.col("name").alias("target"), F.lit(True).alias("_t")), "target", "left")
    cut = ends.withColumn("invalid", F.col("invalid") | F.col("_s").isNotNull() | F.col("_t").isNotNull() | (F.col("age_days") > stale_days)).select(edges.columns)
    return now, cut


def trimmed_entities(entities: DataFrame, most: int) -> DataFrame:
    """Invalid entities go first, then those of least (mentions + 1) / (1 + age / 30). The cut is found by a distributed sort."""
    value = (F.col("mentions") + 1) / (1 + F.col("idle_days") / 30)
    return entities.orderBy("invalid", F.desc(value), "name").limit(most)


def learned_exclusion(memories: DataFrame) -> DataFrame:
    """Rows that were shown in vain five times or more and never used go."""
    return memories.where(~((F.col("miss_count") >= 5) & (F.col("engaged_count") == 0)))


def not_superseded(memories: DataFrame, asks_about_past: bool) -> DataFrame:
    return memories if asks_about_past else memories.where("not superseded")


def routed(memories: DataFrame, user_id: int, max_age: float, words: list[str], least_pool: int = 800, refill: int = 150) -> DataFrame:
    """Candidate pruning of large pools: the user's rows, then a time range if it leaves five, then rows with a word if enough do.

    Pools under ``least_pool`` rows are returned whole; a result under ``refill`` rows is filled with the newest others. The three
    counts come from one pass.
    """
    own = F.col("user_id") == user_id
    recent = own & (F.col("age_days") <= max_age)
    named = reduce(lambda a, b: a | b, [F.contains(F.lower("content"), F.lit(w)) for w in words])
    n = memories.agg(F.count("*").alias("all"), *[F.count(F.when(c, 1)).alias(k) for k, c in (("own", own), ("recent", recent), ("own_named", own & named), ("recent_named", recent & named))]).first()
    if n["all"] < least_pool:
        return memories
    chosen, size, with_words = (recent, n["recent"], n["recent_named"]) if n["recent"] >= 5 else (own, n["own"], n["own_named"])
    if with_words >= max(150, 0.3 * size):
        chosen, size = chosen & named, with_words
    kept = memories.where(chosen)
    return kept if size >= refill else kept.unionByName(memories.where(~F.coalesce(chosen, F.lit(False))).orderBy("age_days", "memory_id").limit(refill - size))


def triggered(messages: DataFrame, triggers: DataFrame, most: int | None = None) -> DataFrame:
    """(message id, trigger_id): triggers of which a keyword stands in the message, by priority. triggers: (trigger_id, keyword, priority, more columns)."""
    keys = triggers.select("trigger_id", "priority", F.lower("keyword").alias("name"))
    hit = occurrences(messages.select("id", "text"), keys.select("name"), any_case=True).join(keys, "name").select("id", "trigger_id", "priority").distinct()
    if most is None:
        return hit.select("id", "trigger_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), "trigger_id"))
    return hit.withColumn("_r", rank).where(F.col("_r") <= most).select("id", "trigger_id")


def fired_reminders(messages: DataFrame, reminders: DataFrame) -> DataFrame:
    """(reminder_id, id, ts): each unfired reminder fires once, at the user's first message with its keyword before it expires."""
    open_ones = reminders.where("fired_at is null").select("reminder_id", F.col("user_id").alias("_u"), "keyword", "expires_at")
    hit = messages.join(open_ones, (F.col("user_id") == F.col("_u")) & F.contains("text", F.col("keyword")) & (F.col("expires_at").isNull() | (F.col("ts") < F.col("expires_at"))))
    return hit.groupBy("reminder_id").agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.min("ts").alias("ts"))


def versions(updates: DataFrame, key: str, order: list[str], keep: int = 10) -> DataFrame:
    """Slowly changing rows: the newest ``keep`` versions of each key with valid_from, valid_until and version from the oldest."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = updates.withColumn("valid_from", F.col(order[0])).withColumn("valid_until", F.lead(order[0]).over(w)).withColumn("version", F.row_number().over(w))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", newest).where(F.col("_r") <= keep).drop("_r")


def merged_near_copies(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id) of rows that a near copy with a longer text, or as long and of less id, replaces. pairs: (a, b)."""
    size = memories.select(F.col("memory_id"), F.length("content").alias("n"))
    both = pairs.join(size.select(F.col("memory_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("memory_id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select(F.when((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))), F.col("b")).otherwise(F.col("a")).alias("memory_id")).distinct()
