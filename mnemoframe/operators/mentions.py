"""Names in texts by one Aho-Corasick automaton for each block of names; entity mentions, the memory index and fact matching on it.

The names are cut into blocks of at most about ``block_chars`` characters by a hash, the number of blocks following from their sum; each
block is broadcast and the texts are scanned once for it. So what is broadcast is bounded, a text costs its length and its hits whatever
the number of names, and no text meets each name in a join. Only distinct names are searched; what they belong to joins in by equality.

Defined cases: null and empty names stand in no text, null texts hold none; a name counts once for each text however often it stands there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T

BLOCK_CHARS = 500_000

# Capitalised words that name nobody.
NO_NAMES = (
    "The This That What When Where How Who Which Why Yes No And But For Not Are Was Were Has Have Had Does Did Will Can May She Her His They "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December"
).split()

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, names: list[str]) -> ahocorasick.Automaton:
    """The block's automaton, built once in a worker; ``key`` names the block."""
    if key not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha() or "一" <= c <= "鿿"


def found_in(automaton: ahocorasick.Automaton, text: str, borders: bool) -> list[str]:
    """Distinct names in the text, in the order of their first ends; with ``borders`` no letter or CJK character may touch them."""
    if not len(automaton):
        return []
    out: dict[str, None] = {}
    for end, name in automaton.iter(text):
        if name not in out:
            first = end + 1 - len(name)
            if not borders or not ((first and _letter(text[first - 1])) or (end + 1 < len(text) and _letter(text[end + 1]))):
                out[name] = None
    return list(out)


def occurrences(texts: DataFrame, names: DataFrame, borders: bool = False, any_case: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, name): which of the names stand in which texts. texts: (id, text); names: (name). With ``any_case`` names come lower-cased."""
    spark = texts.sparkSession
    name = F.lower("name") if any_case else F.col("name")
    distinct = names.select(name.alias("name")).where("name <> ''").distinct()
    chars = distinct.agg(F.sum(F.length("name"))).first()[0] or 0
    n = max(1, -(-2 * chars // block_chars) if chars > block_chars else 1)  # hashed blocks differ in size: half as full on average
    id_type = texts.schema["id"].dataType.simpleString()
    content = texts.select("id", (F.lower("text") if any_case else F.col("text")).alias("text")).where("text is not null")

    def scan(shared) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value)
            for batch in batches:
                at, hits = [], []
                for k, text in enumerate(batch.column(1)):
                    mine = found_in(automaton, text.as_py(), borders)
                    at += [k] * len(mine)
                    hits += mine
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=["id", "name"])

        return content.mapInArrow(run, f"id {id_type}, name string")

    parts = []
    for k in range(n):
        block = distinct.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k) if n > 1 else distinct
        parts.append(scan(spark.sparkContext.broadcast([r.name for r in block.toLocalIterator()])))  # a block's size is bounded
    return reduce(DataFrame.unionAll, parts)


def mentioned(texts: DataFrame, entities: DataFrame, most: int = 5, least_chars: int = 3) -> DataFrame:
    """(id, place, name, known): the ``most`` valid entities of most mentions that a text names (ties by name), then capitalised names.

    texts: (id, text), ids unique; entities: (name, mentions, invalid). A capitalised name that isn't among the first is the entity with
    that name in any case, also an invalid one, or else new (``known`` false); it comes once, in the order of the text.
    """
    valid = entities.where((F.length("name") >= least_chars) & ~F.coalesce("invalid", F.lit(False)))
    hits = occurrences(texts, valid.select("name"), borders=True, any_case=True).withColumnRenamed("name", "_lower")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("mentions"), "name"))
    top = hits.join(valid.select("name", "mentions", F.lower("name").alias("_lower")), "_lower").withColumn("place", rank).where(F.col("place") <= most)
    caps = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,})(?![A-Za-z0-9_])"), F.lit(1))).alias("at", "word")).where(~F.col("word").isin(*NO_NAMES))
    fresh = caps.groupBy("id", F.lower("word").alias("_lower")).agg(F.min_by("word", "at").alias("word"), F.min("at").alias("at")).join(top.select("id", "_lower"), ["id", "_lower"], "left_anti")
    stored = entities.groupBy(F.lower("name").alias("_lower")).agg(F.min("name").alias("_stored"))
    named = fresh.join(stored, "_lower", "left").select("id", (F.row_number().over(Window.partitionBy("id").orderBy("at")) + most).alias("place"), F.coalesce("_stored", "word").alias("name"), F.col("_stored").isNotNull().alias("known"))
    return top.select("id", "place", "name", F.lit(True).alias("known")).unionByName(named)


def activated(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, activation): 0.3 more for each mention, 0.1 for each mention of a neighbour over a valid edge, at most 1.

    As nothing is taken away, the sum capped once is what capping each step gives. entities: (name, activation, invalid); mentions:
    (name) a row each; edges: (source, target, invalid).
    """
    said = mentions.groupBy("name").agg(F.count("*").alias("n"))
    live = edges.where(~F.coalesce("invalid", F.lit(False)))
    ends = live.select(F.col("source").alias("name"), F.col("target").alias("to")).unionAll(live.where("source <> target").select(F.col("target"), F.col("source")))
    near = said.join(ends, "name").groupBy(F.col("to").alias("name")).agg(F.sum("n").alias("m"))
    both = entities.join(said, "name", "left").join(near, "name", "left")
    gain = 0.3 * F.coalesce("n", F.lit(0)) + F.when(F.coalesce("invalid", F.lit(False)), 0.0).otherwise(0.1 * F.coalesce("m", F.lit(0)))
    return both.select("name", F.least(F.lit(1.0), F.coalesce("activation", F.lit(0.0)) + gain).alias("activation"))


def memory_index(memories: DataFrame, entities: DataFrame, least_chars: int = 2) -> DataFrame:
    """(name, memory_id): live memories whose content holds a valid entity's name as it is written."""
    live = memories.where(~F.col("scope").isin("expired", "decayed")).select(F.col("memory_id").alias("id"), F.col("content").alias("text"))
    names = entities.where((F.length("name") >= least_chars) & ~F.coalesce("invalid", F.lit(False))).select("name")
    return occurrences(live, names).select("name", F.col("id").alias("memory_id"))


def fact_matches(queries: DataFrame, facts: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, fact_id, predicate, score): facts whose fields hold words of a query, or whose words the query holds.

    A word counts 2 where it stands in the object or holds it, 1.5 in the predicate, 0.5 in the subject, and 1 for each time it is one of
    the fact's words; the sum is weighed by the confidence (0.7 if none). Of each predicate the ``most`` best stay, ties by fact_id.
    queries: (query_id, word), distinct; facts: (fact_id, subject, predicate, object, confidence), open ones. An empty object matches nothing.
    """
    low = facts.select("fact_id", *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("subject", "predicate", "object")], F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.7).otherwise(F.col("confidence")).alias("confidence"))
    words = queries.select(F.col("word").alias("name")).distinct()
    # distinct values of the fields are searched, so a predicate of a third of the facts is one text
    values = low.select(F.explode(F.array("subject", "predicate", "object")).alias("id")).distinct().select("id", F.col("id").alias("text"))
    held = occurrences(values, words).select(F.col("id").alias("value"), F.col("name").alias("word"))
    holds = occurrences(words.select(F.col("name").alias("id"), F.col("name").alias("text")), low.select(F.col("object").alias("name"))).select(F.col("name").alias("value"), F.col("id").alias("word"))
    fact_words = lambda t: T.pattern_words(t, "cjk24_en2_num")
    weigh = lambda pairs, column, w: low.select("fact_id", F.col(column).alias("value")).join(pairs, "value").select("fact_id", "word", F.lit(w).alias("w"))
    own = low.select("fact_id", F.explode(fact_words(F.concat_ws(" ", "subject", "predicate", "object"))).alias("word")).join(words.withColumnRenamed("name", "word"), "word", "left_semi").select("fact_id", "word", F.lit(1.0).alias("w"))
    parts = [weigh(held.unionByName(holds).distinct(), "object", 2.0), weigh(held, "predicate", 1.5), weigh(held, "subject", 0.5), own]
    by_word = reduce(DataFrame.unionByName, parts).groupBy("fact_id", "word").agg(F.sum("w").alias("w"))
    scored = by_word.join(queries, "word").groupBy("query_id", "fact_id").agg(F.sum("w").alias("w")).join(low.select("fact_id", "predicate", "confidence"), "fact_id").withColumn("score", F.col("w") * F.col("confidence"))
    place = F.row_number().over(Window.partitionBy("query_id", "predicate").orderBy(F.desc("score"), "fact_id"))
    return scored.withColumn("_k", place).where(F.col("_k") <= most).select("query_id", "fact_id", "predicate", "score")
