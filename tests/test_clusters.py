"""Signatures, buckets and topic clusters against plain loops."""

import math
import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from mnemoframe.functions import hashing
from mnemoframe.functions import text as T
from mnemoframe.operators import clusters


def fnv(word):
    h = hashing.FNV_OFFSET
    raw = word.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] | raw[k + 1] << 8)) * hashing.FNV_PRIME) % 2**64
    return h


def memories():
    rng = random.Random(7)
    pools = [["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(25)] for _ in range(4)]
    rows = []
    for k in range(60):
        words = rng.choices(pools[k % 4], k=rng.randint(3, 14)) + rng.choices(["and", "the", "李雷", "北京市"], k=2)
        rows.append((k % 2, k, " ".join(words)))
    return [*rows, (0, 100, None), (1, 101, ""), (1, 102, rows[1][2]), (2, 103, "alone here")]


def tokens(text):
    words = []
    for run in re.findall("[一-鿿]+", text):
        words += [run[i : i + 2] for i in range(len(run) - 1)] + ([run] if 3 <= len(run) <= 4 else [])
    words = list(dict.fromkeys(words + [w.lower() for w in re.findall(r"[a-zA-Z]{2,}|\d+", text)]))
    return [x for k, w in enumerate(words) for x in ([w, f"{w}_{words[k + 1]}"] if k + 1 < len(words) else [w])]


def brute(rows):
    terms = {k: [w.lower() for w in re.findall("[一-鿿]{2,}|[a-zA-Z]{3,}", t or "")] for _, k, t in rows}
    sig, vec = {}, {}
    for user in {u for u, _, _ in rows}:
        mine = [(k, t) for u, k, t in rows if u == user]
        idf = {w: math.log(len(mine) / (1 + sum(w in terms[k] for k, _ in mine))) for k, _ in mine for w in terms[k]}
        for k, t in mine:
            v = [0] * 64
            for w in tokens(t or ""):
                weight = round(idf.get(w, 0.01) * 1_000_000)
                for b in range(64):
                    v[b] += weight if fnv(w) >> b & 1 else -weight
            sig[k] = sum(1 << b for b in range(64) if v[b] > sorted(v)[32])
            vec[k] = {w: terms[k].count(w) * idf[w] for w in terms[k]}
    return sig, vec


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / size if size else 0.0


def test_hash():
    words = ["", "a", "hello", "é", "李雷", "\U0001f600", "x" * 300, "ab"]
    assert [int(x) % 2**64 for x in hashing.fnv1a64_of(words)] == [fnv(w) for w in words]
    assert hashing.fnv1a64_of([]).tolist() == []


def test_clusters_against_loops(spark):
    rows = memories()
    df = spark.createDataFrame(rows, "user_id int, id long, text string")
    sig, vec = brute(rows)
    weighted = clusters.vectors(df)
    assert {r.id: r.signature % 2**64 for r in clusters.signatures(df, weighted).collect()} == sig
    assert {r.id: r.t for r in df.select("id", T.bigram_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()} == {k: tokens(t or "") for _, k, t in rows}
    user = {k: u for u, k, _ in rows}
    pairs = [(a, b) for a, b in combinations(sorted(user), 2) if user[a] == user[b]]
    exact = {(a, b) for a, b in pairs if cosine(vec[a], vec[b]) >= 0.25}
    assert {(r.a, r.b) for r in clusters.cosine_pairs(weighted).collect()} == exact
    near = {(a, b) for a, b in pairs if (sig[a] >> 56 ^ sig[b] >> 56).bit_count() <= 1 and (sig[a] ^ sig[b]).bit_count() / 64 <= 0.4}
    got = {(r.a, r.b) for r in clusters.similar_pairs(df).collect()}
    assert got == near & exact and len(got) > 5
    label = {k: k for k in user}
    for a, b in [*got] * len(user):
        label[a] = label[b] = min(label[a], label[b])
    sizes = {c: [*label.values()].count(c) for c in label.values()}
    assert {r.id: r.cluster for r in clusters.topic_clusters(df).collect()} == {k: c for k, c in label.items() if sizes[c] >= 3}


def test_newest_and_nothing(spark):
    df = spark.createDataFrame(memories(), "user_id int, id long, text string")
    assert {r.id for r in clusters.newest_of(df, 3).where("user_id = 0").collect()} == {100, 58, 56}
    assert clusters.topic_clusters(df.limit(0)).count() == 0 and np.isfinite(clusters.with_cosine(spark.createDataFrame([(100, 103)], "a long, b long"), clusters.vectors(df)).first().cosine)
