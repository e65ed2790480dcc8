"""The activation field: how well each memory answers a free-text query, and recall on top of it.

A query is known to the driver as text, so its terms become column expressions: one scan gathers the corpus figures of these terms
alone (one row), a second scores every memory inside its own row and keeps the best by a distributed top-k. Nothing is shuffled but
the best rows of each task, whatever the corpus holds.

Without a history of activations the weights are those of a cold start (base 0.15, context 0.85) and spreading, momentum and
succession add nothing; without a time range the temporal signal is one half for all rows. Null contents, contents under three
characters and rows of the scopes expired and decayed are no candidates. Ties go by memory_id.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import scores as S
from mnemoframe.functions import signals as G
from mnemoframe.functions import text as T
from mnemoframe.functions.chunks import bound
from mnemoframe.operators import rerank
from mnemoframe.operators.insight import phrase_score

# Words of a query that count little, and question words that count half.
STOP_WORDS = frozenset(
    "the and for that this with from are was were not but have has had will can you your they them their what when where which who whom how did does would could should been being its she "
    "her his him all also than then some such about after before between into through during each very just other more most only over".split()
)
SIGNAL_WORDS = frozenset("what where when how which did does who whom".split())
NO_ENTITIES = frozenset("What When Where How Who Which Why The This That Does Did Has Have Was Were Can Could Would Should Not Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
AWDF_WEIGHT = 0.5


def stem_of(word: str) -> str:
    """The stemmer of ``signals.stem`` for the few words of a query."""
    w = word.lower()
    if len(w) < 4:
        return word
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "i"
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith(("ss", "us")):
        w = w[:-1]
    for suffix, least in (("eed", 0), ("ed", 4), ("ing", 5)):
        if w.endswith(suffix) and len(w) > least:
            w = w if suffix == "eed" else w[: -len(suffix)]
            break
    for suffix, least, by in (("tion", 0, "t"), ("ness", 5, ""), ("ment", 5, ""), ("ful", 5, ""), ("ous", 5, ""), ("ive", 5, ""), ("able", 6, ""), ("ible", 6, ""), ("ally", 6, "al"), ("ly", 4, "")):
        if w.endswith(suffix) and len(w) > least:
            return w[: -len(suffix)] + by
    return w


def expanded(query: str, related: dict[str, float] | None = None) -> dict[str, float]:
    """Terms of a query with weights: CJK pairs, words and stems (question words half, stop words a tenth), then related words."""
    out: dict[str, float] = {}
    for run in re.findall("[一-鿿]+", query):
        out.update({run[i : i + 2]: 1.0 for i in range(len(run) - 1)})
        if 3 <= len(run) <= 4:
            out[run] = 1.0
    for word in re.findall(r"[a-zA-Z]{2,}|\d+", query):
        low = word.lower()
        weight = 0.5 if low in SIGNAL_WORDS else 0.1 if low in STOP_WORDS else 1.0
        out[low] = weight
        if low.isalpha():
            out.setdefault(stem_of(low), weight)
    if len(query) < 15:
        for c in re.findall("[一-鿿]", query):
            out.setdefault(c, 0.5)
    for word, weight in (related or {}).items():
        out.setdefault(word, weight)
    return out


def memory_words(content: Column) -> Column:
    """Distinct CJK windows of two to four characters, Latin words with their stems, and digits."""
    runs = F.regexp_extract_all(content, F.lit("([一-鿿]+)"), F.lit(1))
    window = lambda s, k: F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    cjk = F.flatten(F.transform(runs, lambda s: F.concat(window(s, 2), window(s, 3), window(s, 4))))
    latin = F.array_distinct(T.latin_words(content))
    return F.array_distinct(F.concat(cjk, latin, F.transform(latin, G.stem)))


def computed(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with columns that are computed once: the optimizer copies no expression over a generator, neither into filters nor into
    the expressions that use it."""
    one = rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_one"))
    return one.select("*", *[F.col("_one")[k].alias(k) for k in values]).drop("_one")


def prepared(memories: DataFrame) -> DataFrame:
    """Candidates with their words and base activation."""
    rows = memories.where(~F.col("scope").isin("expired", "decayed") & (F.length("content") >= 3))
    return computed(rows, _words=memory_words(F.col("content")), _base=S.base_activation(F.col("recall_count"), F.col("age_days"), F.col("access_age_days")))


def corpus_figures(rows: DataFrame, terms: list[str]) -> tuple[dict[str, float], dict[str, float], float]:
    """Normalised idf and activation mass of each term, and the mean length in words, from one pass that returns one row."""
    holds = [F.array_contains("_words", t) for t in terms]
    size = F.regexp_count("content", F.lit("[一-鿿]|[a-zA-Z]+"))
    got = rows.agg(
        F.count("*").alias("n"), F.avg(size).alias("mean"),
        *[F.count(F.when(h, 1)).alias(f"d{k}") for k, h in enumerate(holds)], *[F.sum(F.when(h, F.col("_base"))).alias(f"a{k}") for k, h in enumerate(holds)],
    ).first()
    n = got["n"]
    floor = 0.1 if n < 20 else 0.02
    idf = {t: max(floor, math.log(n / got[f"d{k}"]) / math.log(n)) if got[f"d{k}"] and n > 1 else 1.0 for k, t in enumerate(terms)}
    return idf, {t: got[f"a{k}"] or 0.0 for k, t in enumerate(terms)}, got["mean"] or 0.0


def word_score(terms: dict[str, float], idf: dict[str, float], mass: dict[str, float], k1: float, b: float, mean: float, cjk: bool, broad: bool) -> Column:
    """BM25+ over the terms: those of weight .9 or more are the measure, others add at most one half."""
    denominator = mean if mean >= 10 else max(len(terms), 10)
    norm = 1 - b + b * F.size("_words") / denominator
    saturation = (k1 + 1) / (norm + k1)
    zero = F.lit(0.0)
    hits, most = {True: zero, False: zero}, {True: zero, False: zero}
    for term, weight in terms.items():
        share = F.col("_base") / mass[term] if mass[term] > 0 else zero
        effective = weight * idf[term] * (1 + AWDF_WEIGHT * share)
        found = F.array_contains("_words", term) | F.array_contains("_words", stem_of(term)) if term.isascii() and term.isalpha() else F.array_contains("_words", term)
        original = weight >= 0.9
        hits[original] = hits[original] + F.when(found, effective * saturation + k1).otherwise(0.0)
        most[original] = most[original] + effective + k1
    first = hits[True] / F.greatest(most[True], F.lit(0.01)) + 0.5 * hits[False] / F.greatest(most[False], F.lit(0.01))
    second = (hits[True] + hits[False]) / F.greatest(most[True] + most[False], F.lit(1e-9))
    least = (0.01 if broad else 0.03) if cjk else max(0.005, 1 / max(1, len(terms)))
    return bound(F.greatest(first, 0.7 * second), lambda best: F.when(best < least, 0.0).otherwise(best))


def entity_score(query: str, content: Column) -> Column:
    """At most .8, where the content holds a capitalised name of the query and some of its other longer words."""
    names = [w for w in re.findall(r"\b[A-Z][a-z]{2,}\b", query, re.ASCII) if w not in NO_ENTITIES]
    words = [w for w in (x.lower() for x in re.findall("[a-zA-Z]{4,}", query)) if w not in STOP_WORDS and w not in {n.lower() for n in names}]
    if not names or not words:
        return F.lit(0.0)
    low = F.lower(content)
    named = reduce(lambda x, y: x | y, [F.contains(low, F.lit(n.lower())) for n in names])
    found = reduce(lambda x, y: x + y, [(F.contains(low, F.lit(w)) | F.contains(low, F.lit(stem_of(w)))).cast("int") for w in words])
    return F.when(named, F.least(F.lit(0.8), found / float(len(words)))).otherwise(0.0)


def query_parameters(query: str) -> tuple[str, float, float]:
    """Type, k1 and b of a query, as ``signals.query_type`` and ``signals.bm25_parameters`` have them for columns."""
    names = [w for w in re.findall(r"\b[A-Z][a-z]{2,}\b", query, re.ASCII) if w not in G.NO_NAMES]
    kind = "temporal" if re.search(G.TEMPORAL, query) else "multi_entity" if len(names) >= 2 else "precise" if re.search(G.PRECISE, query) else "broad"
    k1, b = G.BM25_MULTIPLIERS[kind]
    cjk = re.search("[一-鿿]", query)
    return kind, 1.2 * k1 * (1.0 if cjk else 1.25), 0.75 * b * (1.0 if cjk else 0.67)


def context_match(memories: DataFrame, query: str, related: dict[str, float] | None = None) -> DataFrame:
    """Candidates with ``context``: the best of word, phrase, trigram and entity score, plus .15 of the second best."""
    kind, k1, b = query_parameters(query)
    terms = expanded(query, related)
    rows = prepared(memories)
    idf, mass, mean = corpus_figures(rows, list(terms))
    cjk = bool(re.search("[一-鿿]", query))
    tokens = [w.lower() for w in re.findall(r"[一-鿿]{2,4}|[a-zA-Z]{2,}|\d+", query)]
    latin = sum(map(len, re.findall("[a-zA-Z]+", query))) / max(1, len(query))
    grams = T.trigrams(F.lit(query))
    channels = [
        word_score(terms, idf, mass, k1, b, mean, cjk, kind == "broad"), 1.2 * phrase_score(tokens, F.col("content")),
        (1.0 if latin > 0.5 else 0.8) * T.jaccard(grams, T.trigrams(F.col("content"))), 0.9 * entity_score(query, F.col("content")),
    ]
    best = F.reverse(F.array_sort(F.array(*channels)))
    return computed(rows, context=bound(best, lambda s: F.get(s, F.lit(0)) + F.when(F.get(s, F.lit(1)) > 0.05, 0.15 * F.get(s, F.lit(1))).otherwise(0.0)))


def activation_field(memories: DataFrame, query: str, mood: float = 0.0, alertness: float = 0.5, related: dict[str, float] | None = None, base_weight: float = 0.15, context_weight: float = 0.85) -> DataFrame:
    """Memories with their signals and ``activation``; rows of almost no context or activation are left out."""
    rows = context_match(memories, query, related).where("context >= 0.002")
    emotion = S.emotion_resonance(F.col("emotion"), F.col("emotion_intensity"), F.lit(None).cast("double"), F.lit(None).cast("double"), mood, alertness)
    raw = (base_weight * F.col("_base") + context_weight * F.col("context")) * (0.5 + 0.5 * emotion) * (0.8 + 0.2 * 0.5)
    importance = (1 + F.greatest(F.lit(0.0), F.coalesce("importance", F.lit(5.0)) - 5) * 0.05) * F.when(F.col("scope") == "correction", 1.5).otherwise(1.0) * F.when(F.col("superseded"), 0.3).otherwise(1.0)
    final = raw * (0.6 + 0.4 * F.coalesce("confidence", F.lit(0.7))) * importance * F.when(F.col("scope").isin("insight", "reflexion"), 1.15).otherwise(1.0)
    return rows.withColumn("activation", final).where("activation > 0.001").drop("_words", "_base")


def recall(memories: DataFrame, query: str, top_n: int = 10, pool: int = 50, **state: float) -> DataFrame:
    """(memory_id, activation, place): the field's best ``pool`` rows after interference among them, the best ``top_n``.

    The pool is bounded, so the sequential interference pass runs on one small group.
    """
    top = activation_field(memories, query, **state).orderBy(F.desc("activation"), "memory_id").limit(pool)
    candidates = top.select(F.lit(0).cast("long").alias("query_id"), "memory_id", "content", "scope", (F.col("age_days") * 86_400_000).cast("long").alias("age_ms"), F.col("activation").alias("score"))
    kept = rerank.interference(candidates, pool).orderBy(F.desc("activation"), "memory_id").limit(top_n)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("activation"), "memory_id"))).select("memory_id", "activation", "place")  # at most top_n rows


def evaluation(results: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, hit rate in the first ``k`` and mean reciprocal rank. results: (query_id, memory_id, place); wanted: (query_id, memory_id)."""
    found = wanted.join(results.where(F.col("place") <= k), ["query_id", "memory_id"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    return found.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("place").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
