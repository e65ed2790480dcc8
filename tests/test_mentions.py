"""Names in texts against one regular expression for each pair."""

import random
import re

import pytest

from mnemoframe.operators import mentions

NAMES = ["ann", "Ann Lee", "lee", "李雷", "c++", "a.b", "été", "x", "", None, "Bob", "bobby", "leeann"]


def texts(n=120):
    rng = random.Random(1)
    parts = ["ann", "Ann", "Lee", " ", " ", "-", "李雷", "王", "c++", "a.b", "axb", "été", "Été", "bob", "Bobby", "X", "1", "_", "The", "Carla", "May"]
    return [(k, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for k in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("borders, any_case, block_chars", [(True, True, 500_000), (False, False, 500_000), (False, True, 8), (True, False, 5)])
def test_occurrences(spark, borders, any_case, block_chars):
    df = spark.createDataFrame(texts(), "id long, text string")
    names = spark.createDataFrame([(x,) for x in [*NAMES, "ann"]], "name string")
    got = sorted(map(tuple, mentions.occurrences(df, names, borders, any_case, block_chars).collect()))
    edge = "[^a-zA-Z一-鿿]"
    want = set()
    for k, t in texts():
        for name in NAMES:
            if name and t is not None:
                low, where = (name.lower(), t.lower()) if any_case else (name, t)
                if re.search(f"(?:^|{edge}){re.escape(low)}(?:{edge}|$)" if borders else re.escape(low), where):
                    want.add((k, low))
    assert got == sorted(want) and want


def test_mentioned(spark):
    entities = spark.createDataFrame([("ann", 5, False), ("Lee", 9, False), ("bob", 7, True), ("Carla", 1, False), ("ab", 99, False), ("zoe", 5, None)], "name string, mentions int, invalid boolean")
    df = spark.createDataFrame([(1, "Ann met lee, Bob and zoe. Dora ab DORA Dora"), (2, "The May Carla"), (3, None)], "id long, text string")
    got = {}
    for r in mentions.mentioned(df, entities, most=2).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.name, r.known))
    # lee and ann lead; Zoe is written small, so only capitalised others follow
    assert got == {1: [("Lee", True), ("ann", True), ("bob", True), ("Dora", False)], 2: [("Carla", True)]}
    assert mentions.mentioned(df.limit(0), entities).count() == 0 and mentions.occurrences(df, entities.limit(0).select("name")).count() == 0


def test_fact_matches(spark):
    facts = [(1, "user", "likes", "black tea", 0.9), (2, "user", "likes", "tea", None), (3, "ann", "owns", "a teapot shop", 0.5), (4, None, "likes", None, 1.0), (5, "user", "likes", "cat", 1.0)]
    words = [(1, "tea"), (1, "likes"), (2, "teapots"), (3, "none")]
    got = {(r.query_id, r.fact_id): round(r.score, 6) for r in mentions.fact_matches(spark.createDataFrame(words, "query_id int, word string"), spark.createDataFrame(facts, "fact_id int, subject string, predicate string, object string, confidence double"), most=9).collect()}
    want = {}
    for q in {q for q, _ in words}:
        mine = [w for k, w in words if k == q]
        for k, s, p, o, c in facts:
            s, p, o = (x or "" for x in (s, p, o))
            score = sum(2 * bool(o and (w in o or o in w)) + 1.5 * (w in p) + 0.5 * (w in s) for w in mine) + sum(w in mine for w in re.findall(r"[一-鿿]{2,4}|[a-zA-Z]{2,}|\d+", f"{s} {p} {o}"))
            if score:
                want[q, k] = round(score * (c or 0.7), 6)
    assert got == want and want
