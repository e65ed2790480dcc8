"""Query expansion over a weighted concept graph held in tables: learned pairs, synonyms, clusters, and concepts walked two hops.

Every source is an equi-join of the queries' words with its table, with a weight of its own: pairs of the association network up to 0.8
(three for each word), clusters 0.85, children of a concept 0.85, synonyms 0.9 and those of one key 0.7, parents and siblings 0.3 where
nothing else names the word, children of the five first synonyms 0.5. A word's weight is the greatest. Nothing is broadcast by hand and
no table is collected; what grows with the corpus are the joins' inputs.

Tables: queries (query_id, word, place from 1), distinct words; pairs (w1, w2, pmi); df (term, df); synonyms (key, synonym, ord);
clusters (word, cluster); concepts (parent, child); junk (word). Ties go by word. Words and keys are compared as they are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.sources.shared import stored

# Weights and thresholds of the sources.
PAIR_MOST, PAIR_SCALE, PAIRS_A_WORD = 0.8, 5.0, 3
SYNONYM, PEER, CLUSTER, CHILD, WEAK, SECOND, SECOND_WORDS = 0.9, 0.7, 0.85, 0.85, 0.3, 0.5, 5
CHILD_STEMS = (("(?i)ies$", "y"), ("(?i)ves$", "f"), ("(?i)ses$", "se"), ("(?i)s$", ""), ("(?i)ing$", ""), ("(?i)ed$", ""))
PARENT_STEMS = (("(?i)ies$", "y"), ("(?i)s$", ""), ("(?i)ing$", ""), ("(?i)ed$", ""))
CJK_WORD = "^[一-鿿]{2,}$"


def paired(queries: DataFrame, pairs: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """(query_id, other, pmi, place, rank): for each word in turn the three strongest others that no earlier word of the query has taken.

    As earlier words take three at most, a word's choice lies among its first 3 * place, so each query carries few candidates.
    """
    least_pmi, least_df = (0.7, 1) if total < 100 else (1.0, 2)
    strong = pairs.where(F.col("pmi") > least_pmi)
    both = strong.select(F.col("w1").alias("word"), F.col("w2").alias("other"), "pmi").unionAll(strong.select("w2", "w1", "pmi"))
    named = queries.select("query_id", F.col("word").alias("other"))
    usual = df.where(F.col("df") >= least_df).select(F.col("term").alias("other"))
    near = queries.join(both, "word").join(named, ["query_id", "other"], "left_anti").join(usual, "other", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc("pmi"), "other"))
    first = near.withColumn("rank", rank).where(F.col("rank") <= PAIRS_A_WORD * F.col("place"))
    listed = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "other", "pmi"))).alias("c"))

    def take(acc: Column, x: Column) -> Column:
        full = F.size(F.filter(acc, lambda t: t["place"] == x["place"])) >= PAIRS_A_WORD
        return F.when(full | F.exists(acc, lambda t: t["other"] == x["other"]), acc).otherwise(F.concat(acc, F.array(x)))

    chosen = F.aggregate("c", F.slice("c", 1, 0), take)
    return listed.select("query_id", F.explode(chosen).alias("t")).select("query_id", "t.other", "t.pmi", "t.place", "t.rank")


def _by_stem(queries: DataFrame, table: DataFrame, column: str, stems: tuple) -> DataFrame:
    """queries joined with ``table`` on the word, or else on the first of its stems that the table has."""
    long_latin = F.col("word").rlike("(?i)^[a-z]{4,}$")
    cut = [F.struct(F.lit(k).alias("k"), F.regexp_replace("word", pattern, by).alias("form")) for k, (pattern, by) in enumerate(stems, 1)]
    forms = queries.select("*", F.explode(F.when(long_latin, F.array(F.struct(F.lit(0).alias("k"), F.col("word").alias("form")), *cut)).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("word").alias("form"))))).alias("f")).where((F.col("f.k") == 0) | (F.col("f.form") != F.col("word")))
    known = table.select(F.col(column).alias("form")).distinct()
    best = forms.select("query_id", "word", "place", "f.k", "f.form").join(known, "form").groupBy("query_id", "word", "place").agg(F.min_by("form", "k").alias("form"))
    return best.join(table.withColumnRenamed(column, "form"), "form")


def expand(queries: DataFrame, pairs: DataFrame, df: DataFrame, total: int, synonyms: DataFrame, clusters: DataFrame, concepts: DataFrame, junk: DataFrame | None = None, damping: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(query_id, word, weight): the query's words at 1, then the ``most`` strongest others. damping: (word, damping), of pairs."""
    # what several sources read is stored as it is found: one plan of all steps, each written out many times, outgrows the driver
    queries = stored(queries)
    own = queries.select("query_id", "word")
    near = stored(paired(queries, pairs, df, total))
    if damping is not None:
        near = near.join(damping.withColumnRenamed("word", "other"), "other", "left")
    else:
        near = near.withColumn("damping", F.lit(1.0))
    at = lambda stage, kind, key, sub, n: F.struct(F.lit(stage).alias("stage"), F.col("place").cast("int").alias("place"), F.lit(kind).alias("kind"), key.cast("long").alias("key"), F.lit(sub).alias("sub"), n.cast("long").alias("n")).alias("at")
    two = lambda c: F.length(c) >= 2
    zero = F.lit(0)
    parts = [near.select("query_id", F.col("other").alias("word"), (F.least(F.lit(PAIR_MOST), F.col("pmi") / PAIR_SCALE) * F.coalesce("damping", F.lit(1.0))).alias("weight"), at(0, 0, zero, 0, F.col("rank")))]
    direct = queries.join(synonyms, F.col("word") == F.col("key"))
    parts.append(direct.where(two("synonym")).select("query_id", F.col("synonym").alias("word"), F.lit(SYNONYM).alias("weight"), at(1, 0, zero, 0, F.col("ord"))))
    first = synonyms.groupBy("key").agg(F.min("ord").alias("first"))
    back = queries.join(synonyms.select(F.col("key"), F.col("synonym").alias("word")).distinct(), "word").join(first, "key")
    parts.append(back.where(two("key")).select("query_id", F.col("key").alias("word"), F.lit(SYNONYM).alias("weight"), at(1, 1, F.col("first"), 0, zero)))
    peers = back.withColumnRenamed("word", "_word").join(synonyms, "key").where(two("synonym") & (F.col("synonym") != F.col("_word")))
    parts.append(peers.select("query_id", F.col("synonym").alias("word"), F.lit(PEER).alias("weight"), at(1, 1, F.col("first"), 1, F.col("ord"))))
    mates = queries.join(clusters, "word").withColumnRenamed("word", "_word").join(clusters, "cluster").where(two("word") & (F.col("word") != F.col("_word")))
    parts.append(mates.select("query_id", "word", F.lit(CLUSTER).alias("weight"), at(2, 0, zero, 0, zero)))
    children = _by_stem(queries, concepts, "parent", CHILD_STEMS)
    parts.append(children.where(two("child")).select("query_id", F.col("child").alias("word"), F.lit(CHILD).alias("weight"), at(3, 0, zero, 0, zero)))
    strong = stored(reduce(DataFrame.unionByName, parts).groupBy("query_id", "word").agg(F.max("weight").alias("strong"), F.min("at").alias("at")).join(own, ["query_id", "word"], "left_anti"))
    up = _by_stem(queries, concepts, "child", PARENT_STEMS)
    beside = up.withColumnRenamed("word", "_word").join(concepts, "parent").where(two("child") & (F.col("child") != F.col("_word")))
    weak = up.select("query_id", F.col("parent").alias("word")).unionByName(beside.select("query_id", F.col("child").alias("word"))).distinct().join(own, ["query_id", "word"], "left_anti").withColumn("weak", F.lit(WEAK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    seeds = strong.where((F.col("strong") >= SYNONYM) & two("word")).withColumn("_r", rank).where(F.col("_r") <= SECOND_WORDS)
    second = seeds.select("query_id", F.col("word").alias("parent")).join(concepts, "parent").where(two("child")).select("query_id", F.col("child").alias("word")).distinct().join(own, ["query_id", "word"], "left_anti").withColumn("second", F.lit(SECOND))
    others = strong.select("query_id", "word", "strong").join(weak, ["query_id", "word"], "full").join(second, ["query_id", "word"], "full").select("query_id", "word", F.greatest(F.coalesce("strong", "weak"), "second").alias("weight"))
    if junk is not None:
        others = others.join(junk, "word", "left_anti")
    others = stored(others)
    # words of CJK characters lead to keys that share a character with them: the first such word of the query counts
    chars = queries.where(F.col("word").rlike(CJK_WORD)).select("query_id", "place", F.explode(F.split("word", "")).alias("c"))
    keys = synonyms.where(two("key")).select("key").distinct().select("key", F.explode(F.array_distinct(F.split("key", ""))).alias("c"))
    alike = chars.join(keys, "c").groupBy("query_id", "key", "place").agg(F.count("*").alias("shared")).groupBy("query_id", F.col("key").alias("word")).agg(F.min_by("shared", "place").alias("shared"))
    alike = alike.join(others.select("query_id", "word").unionByName(own), ["query_id", "word"], "left_anti").select("query_id", "word", F.least(F.lit(0.7), 0.4 * F.col("shared")).alias("weight"))
    others = stored(others.unionByName(alike))
    known = synonyms.select(F.explode(F.array("key", "synonym")).alias("word")).unionByName(concepts.select(F.explode(F.array("parent", "child")).alias("word"))).distinct()
    pieces = others.where(F.col("word").rlike("^[一-鿿]{2}$"))
    others = others.where(~F.col("word").rlike("^[一-鿿]{2}$")).unionByName(pieces.join(known, "word", "left_semi").select("query_id", "word", "weight"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "word"))
    return own.withColumn("weight", F.lit(1.0)).unionByName(others.withColumn("_r", best).where(F.col("_r") <= most).drop("_r"))


# Words of queries that ask for something general, which are expanded further.
ABSTRACT = (
    "方式 习惯 品味 爱好 特点 性格 规划 想法 压力 负担 活动 情况 经历 偏好 风格 水平 能力 状况 态度 目标 计划 条件 背景 圈子 style habit taste hobby trait plan idea preference routine activity experience skill"
).split()


def field_terms(terms: DataFrame, stop_words: list[str], expansion, idf: DataFrame) -> DataFrame:
    """(query_id, word, weight): a query's terms and their expansion, each word of it weakened by its normalised idf (0.5 if unknown, at
    least 0.3). terms: (query_id, word, weight, place); expansion(queries, most) as ``expand`` bound to its tables; idf: (term, idf).

    Words of 0.3 or more are expanded, single CJK characters are not; a query with a general word gives 30 words of at least 0.1, others
    20 of at least 0.15.
    """
    words = terms.where((F.col("weight") >= 0.3) & (F.length("word") >= 2)).select("query_id", "word", "place")
    general = words.where(~F.col("word").isin(*stop_words) & F.col("word").isin(*ABSTRACT)).select("query_id").distinct()
    own = terms.select("query_id", "word")
    others = expansion(words, 30).join(own, ["query_id", "word"], "left_anti").join(general.withColumn("general", F.lit(True)), "query_id", "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "word"))
    kept = others.withColumn("_r", rank).where(F.when(F.col("general"), F.col("weight") >= 0.1).otherwise((F.col("weight") >= 0.15) & (F.col("_r") <= 20)))
    weakened = kept.join(idf.select(F.col("term").alias("word"), "idf"), "word", "left")
    return terms.select("query_id", "word", "weight").unionByName(weakened.select("query_id", "word", (F.col("weight") * F.greatest(F.lit(0.3), F.coalesce("idf", F.lit(0.5)))).alias("weight")))


def dimensions(words: DataFrame, synonyms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(word, dimension): s:key of the synonym keys that a word belongs to and c:parent of its concepts, lower-cased. words: (word)."""
    low = words.select(F.lower("word").alias("word")).distinct()
    keys = synonyms.select(F.lower("synonym").alias("word"), F.concat(F.lit("s:"), "key").alias("dimension"))
    parents = concepts.select(F.lower("child").alias("word"), F.concat(F.lit("c:"), F.lower("parent")).alias("dimension"))
    return low.join(keys.unionByName(parents).distinct(), "word")


def dimension_overlap(memories: DataFrame, terms: DataFrame, synonyms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, memory_id, overlap): the share of a query's dimensions that a memory has, rare ones counting more.

    A memory has the dimensions of its first 20 Latin words of three letters or more, a query those of its terms of 0.5 or more; a
    dimension weighs one over the number of memories that have it. Rows of no overlap are left out. memories: (memory_id, content);
    terms: (query_id, word, weight).
    """
    words = memories.select("memory_id", F.explode(F.slice(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{3,})"), F.lit(1)), 1, 20)).alias("word")).distinct()
    of_word = dimensions(words.select("word").unionByName(terms.select("word")), synonyms, concepts)
    held = words.join(of_word, "word").select("memory_id", "dimension").distinct()
    wanted = terms.where(F.col("weight") >= 0.5).join(of_word, "word").select("query_id", "dimension").distinct()
    counts = held.groupBy("dimension").agg(F.count("*").alias("n"))
    weighed = wanted.join(counts, "dimension", "left").withColumn("w", 1 / F.greatest(F.lit(1), F.coalesce("n", F.lit(1))))
    total = weighed.groupBy("query_id").agg(F.sum("w").alias("total"))
    hits = held.join(weighed, "dimension").groupBy("query_id", "memory_id").agg(F.sum("w").alias("w"))
    return hits.join(total, "query_id").select("query_id", "memory_id", (F.col("w") / F.col("total")).alias("overlap"))
