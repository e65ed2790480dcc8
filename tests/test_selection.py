"""Selections against loops over whole lists."""

import math
import random
import re

import pytest

from mnemoframe.operators import selection as S

WORDS = ["Ann", "bob", "tea", "plan", "memory", "emotion", "rule", "flow", "sea", "wind"]


def test_covering(spark):
    rng = random.Random(3)
    rows = [(q, k, rng.choice([None, *[" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(6)]]), round(rng.random(), 1)) for q in range(6) for k in range(rng.choice([3, 12, 30]))]
    wants = [(q, w) for q in range(5) for w in rng.sample(WORDS, 4)]
    got = {}
    for r in S.covering(spark.createDataFrame(rows, "query_id long, memory_id long, content string, activation double"), spark.createDataFrame(wants, "query_id long, word string"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    for q in range(6):
        pool = sorted(((k, (t or "").lower(), a) for x, k, t, a in rows if x == q), key=lambda r: (-r[2], r[0]))
        wanted = {w.lower() for x, w in wants if x == q}
        n, out, uncovered = len(wanted), [], set(wanted)
        if not n or len(pool) <= 5:
            out, pool = [k for k, _, _ in pool[:5]], []
        pool = pool[:10]
        while pool and len(out) < 5:
            scores = [0.6 / (1 + i) + 0.4 * sum(w in t for w in uncovered) / n for i, (_, t, _) in enumerate(pool)]
            k, t, _ = pool.pop(max(range(len(pool)), key=lambda i: (scores[i], -i)))
            out.append(k)
            uncovered -= {w for w in uncovered if w in t}
        assert got[q] == out and len(out) == len(set(out)) == min(5, len([r for r in rows if r[0] == q]))


@pytest.mark.parametrize("temporal, top_n", [(False, 8), (True, 7), (True, 4)])
def test_coordinated(spark, temporal, top_n):
    rng = random.Random(top_n)
    rows = [(q, k, f"text {rng.randint(0, 25)}", rng.choice(["episode", "fact"]), rng.choice([True, False, None]), *[round(rng.random(), 2) for _ in range(3)], rng.choice([0.0, 0.5, 0.7]), rng.choice([0.0, 0.2, 0.4])) for q, n in ((1, 60), (2, 5), (3, 200)) for k in range(n)]
    names = ["query_id", "memory_id", "content", "scope", "summary", "activation", "context", "base", "temporal", "spread"]
    got = {}
    for r in S.coordinated(spark.createDataFrame(rows, "query_id long, memory_id long, content string, scope string, summary boolean, activation double, context double, base double, temporal double, spread double"), top_n, temporal).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    for q in (1, 2, 3):
        results = sorted((dict(zip(names, r)) for r in rows if r[0] == q), key=lambda r: (-r["activation"], r["memory_id"]))
        if len(results) <= top_n or top_n < 6:
            assert got[q] == [r["memory_id"] for r in results[:top_n]]
            continue
        out, seen = [], set()

        def take(order, most):
            for r in order:
                if len(out) >= most:
                    break
                if r["content"] not in seen:
                    out.append(r)
                    seen.add(r["content"])

        by = lambda c: sorted(results, key=lambda r: -r[c])
        first = {}
        for r in results:  # of equal contents the one of highest activation stands for all
            first.setdefault(r["content"], r)
        results = [r for r in results if first[r["content"]] is r]
        take(results, math.ceil(top_n * 0.5))
        take(by("context"), math.ceil(top_n * 0.7))
        take(by("base"), math.ceil(top_n * 0.9))
        if temporal:
            take([r for r in by("temporal") if r["temporal"] > 0], top_n - 1)
        take([r for r in by("spread") if r["spread"] > 0], top_n - 1)
        take([r for r in results if r["scope"] == "episode" and not r["summary"]], top_n)
        take(results, top_n)
        assert got[q] == [r["memory_id"] for r in sorted(out, key=lambda r: (-r["activation"], r["memory_id"]))]


def test_within_shares(spark):
    rng = random.Random(9)
    rows = [(q, k, " ".join(rng.choices(WORDS, k=rng.randint(2, 6))) + rng.choice(["", " again and again", f" {k}"]), rng.randint(1, 9), rng.choice([5, 20, 60, 500])) for q in (1, 2, 3) for k in range(70)] + [(4, 1, None, 5, 5), (5, 1, "one", 1, 9999)]
    got = {}
    for r in S.within_shares(spark.createDataFrame(rows, "query_id long, text_id long, content string, priority int, tokens int"), 300, 1.1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.text_id)
    for q in (1, 2, 3):
        seen, mine = set(), []
        for _, k, t, p, n in [r for r in rows if r[0] == q]:
            if t not in seen:
                seen.add(t)
                kind = next((i for i, words in enumerate(S.CATEGORIES.values()) if re.search("|".join(words), t.lower())), 4)
                mine.append((-p, kind, k, n, t))
        mine.sort()
        used, chosen = 0, []
        for kind in range(5):
            bucket = [m for m in mine if m[1] == kind]
            for _ in range(min(3 if kind == 0 else 1, len(bucket))):
                if used + bucket[0][3] <= 330:
                    used += bucket[0][3]
                    chosen.append(bucket.pop(0))
        for m in mine:
            if m not in chosen and used + m[3] <= 330:
                used += m[3]
                chosen.append(m)
        grams = lambda t: {t.lower()[k : k + 3] for k in range(len(t) - 2)}
        out = []
        for m in chosen:
            if not any(len(grams(m[4]) & grams(o[4])) / len(grams(m[4]) | grams(o[4])) > 0.4 for o in out):
                out.append(m)
        assert got[q] == [m[2] for m in out]
    assert 4 not in got and 5 not in got
