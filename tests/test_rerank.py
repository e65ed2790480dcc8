"""Greedy reranks against plain loops, edge cases of chunkers and budgets."""

from pyspark.sql import functions as F

from mnemoframe.functions import chunks as C
from mnemoframe.functions import dialogue as D
from mnemoframe.operators import rerank

TEXTS = ["the red fox runs home", "the red fox runs home", "the red fox ran home", "a blue whale sings", "", None, "a blue whale sang"]


def grams(t):
    t = " ".join((t or "").lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def sim(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def candidates(spark):
    rows = [(1, i, t, "fact" if i == 1 else "event", 3600000 * (i + 1), 1.0 - i // 2 / 10) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "query_id long, memory_id long, content string, scope string, age_ms long, score double")


def test_diversified(spark):
    rows, chosen = [(r.memory_id, r.content, r.score) for r in candidates(spark).collect()], []
    while len(chosen) < 5:
        chosen.append(max((r for r in rows if r not in chosen), key=lambda r: (0.7 * r[2] - (1 - 0.7) * max([sim(r[1], c[1]) for c in chosen], default=0.0), r[2], -r[0])))
    got = rerank.diversified(candidates(spark), 5).orderBy("rank").collect()
    assert [r.memory_id for r in got] == [c[0] for c in chosen]


def test_interference(spark):
    got = {r.memory_id: r.activation for r in rerank.interference(candidates(spark), 10).collect()}
    assert got[0] == 1.0 and got[1] == 0.5  # a summary that repeats the best row
    assert abs(got[2] - 0.9 * 0.3) < 1e-9  # nearly the same words
    assert got[3] == 0.9 and got[4] == 0.8 and got[5] == 0.8  # nothing alike; texts without trigrams are like none
    assert rerank.interference(candidates(spark), 2).count() == 2
    assert rerank.interference(candidates(spark).limit(0), 2).count() == 0


def test_budget(spark):
    rows = spark.createDataFrame([(1, 1, "one two"), (1, 2, None), (1, 3, "three")], "k int, o int, content string")
    got = rerank.within_budget(rows.fillna(""), ["k"], ["o"], 23.0).orderBy("o").collect()
    assert [(r.o, r.used) for r in got] == [(1, 12.6), (2, 22.6)]


def test_chunks(spark):
    long = "word " * 150 + ". " + "more " * 50
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "short"), (4, "one paragraph here\n\nand two here"), (5, long)], "id int, t string")
    got = {r.id: r.c for r in rows.select("id", C.by_paragraph(F.col("t")).alias("c")).collect()}
    assert got[1] == [] and got[2] is None and got[3] == [] and got[4] == ["one paragraph here\n\nand two here"]
    assert [c[:4] for c in got[5]] == ["word", "more"]


def test_reasoning(spark):
    rows = spark.createDataFrame([("because it rains so we stay at home",), ("因为下雨了所以我们在家里",), ("no reason",), (None,)], "t string")
    got = [r.r for r in rows.select(D.reasoning(F.col("t")).alias("r")).collect()]
    assert got[0].context == "it rains" and got[1].conclusion == "我们在家里" and got[2] is None and got[3] is None
