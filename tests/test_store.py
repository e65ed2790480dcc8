"""The store, rollups, graph and field on small tables against plain loops: nulls, ties, repeated rows, empty tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import signals as G
from mnemoframe.functions import text as T
from mnemoframe.operators import field, graph, insight, lifecycle, store
from mnemoframe.sources.tables import MEMORY_COLUMNS, session_log

DAY = datetime.datetime(2024, 1, 1)


def test_supersession_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice(["likes", "name"]), rng.choice(["x", "xyz", "xyzuvw", None]), rng.random(), DAY + datetime.timedelta(minutes=k)) for k in range(200)]
    got = {r.fact_id: (r.written, r.valid_until) for r in store.superseded(spark.createDataFrame(rows, "fact_id int, subject string, predicate string, object string, confidence double, ts timestamp")).collect()}
    state, written, closing = {}, {}, {}
    for k, s, p, o, c, ts in rows:
        if p == "likes":
            written[k] = o not in state.setdefault((s, p), set())
            state[s, p].add(o)
            continue
        now = state.get((s, p))
        written[k] = now is None or now[0] is None or (o is not None and o != now[0] and not (len(o) < len(now[0]) / 2 and now[1] >= c))
        if written[k]:
            if now:
                closing[now[2]] = ts
            state[s, p] = (o, c, k)
    assert {k: v for k, (v, _) in got.items()} == written
    assert {k: t for k, (_, t) in got.items() if t} == closing


def test_value_at(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 1.5, rng.random() * 100, -3.0]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for rank in (0, 1, 250, 499):
        assert lifecycle.value_at(rows, "x", rank, few=20, cells=8) == sorted(values)[rank]


def test_components_against_a_loop(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [(f"z{k}", f"z{k + 1}") for k in range(9)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_stemmers_agree(spark):
    words = ["ponies", "dresses", "cats", "bus", "glass", "agreed", "walked", "running", "ring", "nation", "kindness", "movement", "hopeful", "famous", "active", "readable", "visible", "finally", "quickly", "fly", "is", "a", "Cities"]
    got = [r.s for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(G.stem(F.col("w")).alias("s")).collect()]
    assert got == [field.stem_of(w) for w in words]
    assert got[:5] == ["poni", "dress", "cat", "bus", "glass"]


def test_trigrams_of_long_and_odd_texts(spark):
    texts = ["ab", "a  B c", "日本語テ", "😀ab", "x" * 100_000, None]
    got = [r.g for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(T.trigrams(F.col("t")).alias("g")).collect()]
    assert got[0] == [] and got[1] == ["a b", " b ", "b c"] and got[2] == ["日本語", "本語テ"] and got[3] == ["😀ab"] and got[4] == ["xxx"]


def test_session_log_keeps_the_order(spark, tmp_path):
    lines = [{"type": "message", "message": {"role": r, "content": c}} for r, c in (("user", "the first message"), ("assistant", [{"text": "the second"}, {"text": "message"}]), ("user", "short"), ("user", "the third message"))]
    (tmp_path / "s.jsonl").write_text("\n".join(["no json", *map(json.dumps, lines), json.dumps({"type": "other"})]))
    got = [(r.position, r.content) for r in session_log(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == [(1, "the first message"), (2, "the second message"), (4, "the third message")]


@pytest.fixture(scope="module")
def memories(spark):
    texts = ["Alice likes the red bicycle", "Alice likes the red bicycle", "Bob went to Paris with Alice in spring", None, "", "x", "咖啡很好喝", "nothing at all here"]
    return spark.createDataFrame([(8 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr(*MEMORY_COLUMNS)


def test_recall(memories):
    got = field.recall(memories, "which bicycle does Alice like").collect()  # row 0 says the same but is superseded
    assert got[0].memory_id == 8 and [r.place for r in got] == list(range(1, len(got) + 1))
    assert {r.memory_id for r in got} <= {0, 8, 16, 48, 56} and all(r.activation > 0.001 for r in got)
    cjk = field.recall(memories, "咖啡").collect()
    assert cjk[0].memory_id == 48
    assert field.recall(memories.limit(0), "anything").count() == 0


def test_empty_tables(memories, spark):
    none = memories.limit(0)
    assert store.routed(none, 1, 10.0, ["a"]).count() == 0 and store.keyword_search(none, ["a"]).count() == 0 and lifecycle.evict(none).count() == 0
    assert insight.promotions(none.selectExpr("*", "0 as engaged_count", "0 as miss_count", "0.0D as stability")).count() == 0
    assert insight.sampled(none.select("memory_id"), "memory_id", 3, 1).count() == 0


def test_folded_state_by_key(spark):
    rows = [("a", k, float(k)) for k in range(5)] + [("b", 0, None), ("b", 1, 2.0)]
    got = {(r.g, r.k): r.s for r in insight.folded(spark.createDataFrame(rows, "g string, k int, v double"), "g", ["k"], ["v"], 0.0, lambda s, v: s + (v or 0), "s").collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 3, ("a", 3): 6, ("a", 4): 10, ("b", 0): 0, ("b", 1): 2}
