"""URL filters by a temporal list join.

Dated list entries (add, remove) of one list, kind and pattern follow each other in time; each ``add`` is valid from its date until
the next entry of that pattern. A capture is looked up under all suffixes of its host (kind ``domain``) and all prefixes of its
host and path at slashes (kind ``prefix``), as of its fetch time: the interval that holds it decides. A capture is blocked if a
block entry is active and no allow entry whose pattern is as long or longer.

The join is on (kind, pattern); a host with very many captures meets the few intervals of its patterns, and adaptive execution
splits such captures. All in DataFrame functions.

Defined cases: null or malformed URLs and null fetch times match nothing and are not blocked; entries with nulls are ignored;
equal entries count once; of an add and a remove at one instant the remove holds. Captures equal in id, URL and time become one
row, n_captures tells how many. Empty lists block nothing; empty captures give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of dated entries (list, kind, pattern, action, dated); valid_to is open or null."""
    rows = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "dated").dropna().distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy("dated", F.when(F.col("action") == "add", 0).otherwise(1))
    return rows.withColumn("valid_to", F.lead("dated").over(order)).where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("dated")))).select("list", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def keys_of(url: F.Column) -> F.Column:
    """Array of (kind, pattern) under which a URL is looked up; one null element if it has no host."""
    parts = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("pattern")))
    steps = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("pattern")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pattern")))
    return F.when(F.coalesce(host_of(url), F.lit("")) != "", F.concat(suffixes, prefixes)).otherwise(none)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: (page_id, url, fetched_at). One row per distinct capture with its active entries and the verdict."""
    rows = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n_captures"))
    keyed = rows.select("*", F.explode(keys_of(F.col("url"))).alias("key")).select("page_id", "url", "fetched_at", "n_captures", "key.kind", "key.pattern")
    active = intervals(entries).select("list", F.col("kind").alias("k"), F.col("pattern").alias("p"), "valid_from", "valid_to")
    at = F.col("fetched_at")
    joined = keyed.join(active, (F.col("kind") == F.col("k")) & (F.col("pattern") == F.col("p")) & (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))), "left")
    size = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.length("p"))), F.lit(0))
    out = joined.groupBy("page_id", "url", "fetched_at", "n_captures").agg(
        F.count(F.when(F.col("list") == "block", 1)).alias("n_block"), F.count(F.when(F.col("list") == "allow", 1)).alias("n_allow"), size("block").alias("block_length"), size("allow").alias("allow_length")
    )
    return out.withColumn("blocked", (F.col("n_block") > 0) & (F.col("allow_length") < F.col("block_length")))
