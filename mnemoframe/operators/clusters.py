"""Topic clusters of each user's memories: signatures of weighted votes, buckets with one-bit neighbours, sparse cosine, components.

All of it is aggregations and equi-joins within a user: document frequencies, votes of tokens for the 64 bits of a signature (weights are
in millionths, so that sums are exact in any order), pairs of a bucket and the eight that differ from it in one bit, their bits apart,
then the cosine of their vectors over the pairs that are left. A user takes part with the newest ``newest`` memories, as the clusters are
of recent topics; that bounds each bucket and with it the pairs. ``cosine_pairs`` compares all pairs that share a term, exactly.

Defined cases: null texts have no term and no token, their signature is 0; vectors without weight are like none; ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.functions.hashing import BITS, bits_apart, fnv1a64, signature, votes
from mnemoframe.operators.graph import components

# Thresholds of the clustering.
BUCKET_BITS, MOST_APART, LEAST_COSINE, LEAST_SIZE, NEWEST, UNKNOWN = 8, 0.4, 0.25, 3, 200, 0.01
MILLION = 1_000_000


def newest_of(memories: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Each user's ``newest`` rows by id. memories: (user_id, id, text)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    return memories.withColumn("_r", rank).where(F.col("_r") <= newest).drop("_r")


def vectors(memories: DataFrame) -> DataFrame:
    """(user_id, id, term, tf, idf, weight): the terms of each memory, weighted by log(N / (1 + df)) among its user's memories."""
    terms = memories.select("user_id", "id", F.explode(T.pattern_words(F.col("text"), "cjk2_en3")).alias("term")).select("user_id", "id", F.lower("term").alias("term")).groupBy("user_id", "id", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("user_id", "term").agg(F.count("*").alias("df"))
    sizes = memories.groupBy("user_id").agg(F.count("*").alias("n"))
    idf = df.join(sizes, "user_id").select("user_id", "term", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))
    return terms.join(idf, ["user_id", "term"]).select("user_id", "id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def signatures(memories: DataFrame, weighted: DataFrame) -> DataFrame:
    """(user_id, id, signature): tokens and pairs of neighbouring ones vote with their idf, 0.01 if they are no term."""
    idf = weighted.select("user_id", "term", F.round(F.col("idf") * MILLION).cast("long").alias("w")).distinct()
    tokens = memories.select("user_id", "id", F.explode(T.bigram_tokens(F.col("text"))).alias("term"))
    voting = tokens.join(idf, ["user_id", "term"], "left").select("user_id", "id", fnv1a64("term").alias("h"), F.coalesce("w", F.lit(round(UNKNOWN * MILLION))).cast("long").alias("w"))
    voted = voting.groupBy("user_id", "id").agg(*votes(F.col("h"), F.col("w"))).select("user_id", "id", signature([f"v{k}" for k in range(BITS)]).alias("signature"))
    return memories.select("user_id", "id").join(voted, ["user_id", "id"], "left").select("user_id", "id", F.coalesce("signature", F.lit(0)).cast("long").alias("signature"))


def bucket_pairs(signed: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(user_id, a, b, apart) with a < b: pairs of which the leading ``bits`` bits differ in one at most; apart is the share of all bits."""
    bucket = F.shiftrightunsigned("signature", BITS - bits)
    left = signed.select("user_id", F.col("id").alias("a"), F.col("signature").alias("sa"), F.explode(F.array(bucket, *[bucket.bitwiseXOR(F.lit(1 << k)) for k in range(bits)])).alias("bucket"))
    right = signed.select("user_id", F.col("id").alias("b"), F.col("signature").alias("sb"), bucket.alias("bucket"))
    return left.join(right, ["user_id", "bucket"]).where("a < b").select("user_id", "a", "b", (bits_apart(F.col("sa"), F.col("sb")) / BITS).alias("apart"))


def with_cosine(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """pairs and the cosine of their vectors, 0 where they share no term or one has no weight."""
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    va, vb = (weighted.select(F.col("id").alias(side), "term", F.col("weight").alias(f"w{side}")) for side in "ab")
    dots = pairs.select("a", "b").join(va, "a").join(vb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return _scaled(pairs.join(dots, ["a", "b"], "left"), norms)


def _scaled(dots: DataFrame, norms: DataFrame) -> DataFrame:
    both = dots.join(norms.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a", "left").join(norms.select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b", "left")
    size = F.col("na") * F.col("nb")
    return both.withColumn("cosine", F.when(size > 0, F.coalesce("dot", F.lit(0.0)) / size).otherwise(0.0)).drop("dot", "na", "nb")


def cosine_pairs(weighted: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(user_id, a, b, cosine) of all pairs of a user's memories of cosine ``least`` or more: the exact way beside the buckets.

    Terms of no weight add nothing and are left out; the sums of a pair are combined before they are shuffled.
    """
    live = weighted.where("weight <> 0")
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    va, vb = (live.select("user_id", F.col("id").alias(side), "term", F.col("weight").alias(f"w{side}")) for side in "ab")
    dots = va.join(vb, ["user_id", "term"]).where("a < b").groupBy("user_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return _scaled(dots, norms).where(F.col("cosine") >= least).select("user_id", "a", "b", "cosine")


def similar_pairs(memories: DataFrame) -> DataFrame:
    """(user_id, a, b, apart, cosine): pairs of near buckets, near signatures and alike vectors. memories: (user_id, id, text), unique ids."""
    weighted = vectors(memories)
    near = bucket_pairs(signatures(memories, weighted)).where(F.col("apart") <= MOST_APART)
    return with_cosine(near, weighted).where(F.col("cosine") >= LEAST_COSINE).select("user_id", "a", "b", "apart", "cosine")


def topic_clusters(memories: DataFrame, newest: int = NEWEST, least_size: int = LEAST_SIZE) -> DataFrame:
    """(id, cluster) of the clusters of ``least_size`` memories or more; a cluster is named by its least id."""
    found = components(similar_pairs(newest_of(memories, newest)).select("a", "b"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("component")
    return found.join(sizes, "component", "left_semi").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
