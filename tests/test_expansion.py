"""Query expansion against a loop over one query at a time that keeps a dictionary of weights."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import expansion as X


def tables(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("art", "book", "city", "dog", "eat") for b in ("", "s", "ing", "y", "ies")] + ["吃饭", "饭店", "店员", "火锅", "锅底", "吃", "x", "junk"]
    pairs = list({tuple(sorted(rng.sample(words, 2))): round(rng.uniform(0.5, 6), 3) for _ in range(90)}.items())
    df = [(w, rng.randint(1, 9)) for w in words]
    synonyms = [(rng.choice(words), rng.choice(words), k) for k in range(14)]
    clusters = [(w, rng.randint(0, 9)) for w in words if rng.random() < 0.3]
    concepts = sorted({(rng.choice(words), rng.choice(words)) for _ in range(22)})
    queries = [(q, w, k) for q in range(12) for k, w in enumerate(rng.sample(words, rng.randint(1, 6)), 1)]
    return queries, [(a, b, p) for (a, b), p in pairs], df, synonyms, clusters, concepts


def loop(words, pairs, df, total, synonyms, clusters, concepts, junk, most):
    out = {w: 1.0 for w in words}
    strength = {}
    for a, b, p in pairs:
        strength[a, b] = strength[b, a] = p
    low, least = (0.7, 1) if total < 100 else (1.0, 2)
    for w in words:
        near = sorted(((-p, b) for (a, b), p in strength.items() if a == w and b not in out and p > low and dict(df).get(b, 0) >= least))
        for p, b in near[:3]:
            out[b] = max(out.get(b, 0), min(0.8, -p / 5))
    of, back = {}, {}
    for key, s, _ in synonyms:
        of.setdefault(key, []).append(s)
        if key not in back.setdefault(s, []):
            back[s].append(key)
    order = {k: i for i, k in enumerate(of)}
    up = lambda w, v: out.__setitem__(w, max(out.get(w, 0), v))
    for w in words:
        for s in of.get(w, []):
            if len(s) >= 2:
                up(s, 0.9)
        for key in sorted(back.get(w, []), key=order.get):
            if len(key) >= 2:
                up(key, 0.9)
            for s in of[key]:
                if s != w and len(s) >= 2:
                    up(s, 0.7)
    group = {}
    for w, c in clusters:
        group.setdefault(c, []).append(w)
    for w in words:
        for c in [c for x, c in clusters if x == w]:
            for peer in group[c]:
                if peer != w and len(peer) >= 2:
                    up(peer, 0.85)
    children, parents = {}, {}
    for p, c in concepts:
        children.setdefault(p, []).append(c)
        parents.setdefault(c, []).append(p)

    def find(table, w, stems):
        if w in table:
            return table[w]
        if len(w) >= 4 and re.fullmatch("[a-zA-Z]+", w):
            for pattern, by in stems:
                form = re.sub(pattern, by, w)
                if form != w and form in table:
                    return table[form]
        return []

    for w in words:
        for c in find(children, w, X.CHILD_STEMS):
            if len(c) >= 2:
                up(c, 0.85)
        for p in find(parents, w, X.PARENT_STEMS):
            out.setdefault(p, 0.3)
            for s in children[p]:
                if s != w and len(s) >= 2:
                    out.setdefault(s, 0.3)
    for w in [w for w, v in out.items() if v >= 0.9 and w not in words and len(w) >= 2][:5]:
        for c in children.get(w, []):
            if len(c) >= 2:
                up(c, 0.5)
    for w in [w for w in out if w not in words and w in junk]:
        del out[w]
    for w in words:
        if re.fullmatch("[一-鿿]{2,}", w):
            for key in of:
                shared = sum(c in key for c in w)
                if key not in out and shared and len(key) >= 2:
                    out[key] = min(0.7, 0.4 * shared)
    known = {x for k, s, _ in synonyms for x in (k, s)} | {x for pair in concepts for x in pair}
    others = {w: v for w, v in out.items() if w not in words and not (re.fullmatch("[一-鿿]{2}", w) and w not in known)}
    return {w: 1.0 for w in words} | dict(sorted(others.items(), key=lambda x: (-x[1], x[0]))[:most])


@pytest.mark.parametrize("seed, total", [(1, 50), (2, 500), (3, 500), (4, 50)])
def test_expansion_against_a_loop(spark, seed, total):
    queries, pairs, df, synonyms, clusters, concepts = tables(seed)
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {}
    frames = made(queries, "query_id int, word string, place int"), made(pairs, "w1 string, w2 string, pmi double"), made(df, "term string, df int"), total, made(synonyms, "key string, synonym string, ord int"), made(clusters, "word string, cluster int"), made(concepts, "parent string, child string")
    for r in X.expand(*frames, junk=made([("junk",)], "word string"), most=8).collect():
        got.setdefault(r.query_id, {})[r.word] = round(r.weight, 9)
    for q in {q for q, _, _ in queries}:
        words = [w for k, w, _ in queries if k == q]
        want = loop(words, pairs, df, total, synonyms, clusters, concepts, {"junk"}, 8)
        assert got[q] == {w: round(v, 9) for w, v in want.items()}, words
    assert X.expand(frames[0].limit(0), *frames[1:]).count() == 0


def test_terms_and_dimensions(spark):
    synonyms = spark.createDataFrame([("dog", "hound", 0), ("dog", "puppy", 1), ("cat", "puppy", 2)], "key string, synonym string, ord int")
    concepts = spark.createDataFrame([("Pet", "puppy"), ("pet", "hamster")], "parent string, child string")
    words = spark.createDataFrame([("Puppy",), ("hound",), ("none",)], "word string")
    assert sorted(map(tuple, X.dimensions(words, synonyms, concepts).collect())) == [("hound", "s:dog"), ("puppy", "c:pet"), ("puppy", "s:cat"), ("puppy", "s:dog")]
    memories = spark.createDataFrame([(1, "A hound, and a hamster"), (2, "puppy"), (3, "w " * 5 + "one two " * 12 + "puppy"), (4, None)], "memory_id int, content string")
    terms = spark.createDataFrame([(1, "puppy", 1.0), (1, "hamster", 0.4), (2, "none", 1.0)], "query_id int, word string, weight double")
    got = {(r.query_id, r.memory_id): round(r.overlap, 9) for r in X.dimension_overlap(memories, terms, synonyms, concepts).collect()}
    # s:dog and c:pet are held by two memories, s:cat by one: 1/2, 1/2 and 1
    assert got == {(1, 1): 0.5, (1, 2): 1.0}
    fixed = lambda q, most: q.select("query_id").distinct().select("query_id", F.explode(F.expr("array(struct('extra' as word, 0.3D as weight), struct('weak' as word, 0.12D as weight))")).alias("x")).select("query_id", "x.word", "x.weight")
    asked = spark.createDataFrame([(1, "habit", 1.0, 1), (2, "x", 1.0, 1), (3, "dog", 0.2, 1), (4, "dog", 1.0, 1)], "query_id int, word string, weight double, place int")
    rows = {(r.query_id, r.word): round(r.weight, 9) for r in X.field_terms(asked, ["the"], fixed, spark.createDataFrame([("extra", 0.1)], "term string, idf double")).collect()}
    assert rows == {(1, "habit"): 1.0, (2, "x"): 1.0, (3, "dog"): 0.2, (4, "dog"): 1.0, (1, "extra"): 0.09, (1, "weak"): 0.06, (4, "extra"): 0.09}
