import json

from pyspark.sql import functions as F

from mnemoframe.functions import scores as S
from mnemoframe.functions import text as T
from mnemoframe.operators import graph, recall, stats
from mnemoframe.sources import sinks, tables
from mnemoframe.streaming import events as streaming


def test_jaccard_is_symmetric_and_bounded(spark):
    rows = spark.createDataFrame([("abcd", "abce"), ("ab", "ab"), ("same text", "same text"), ("", "x")], "a string, b string")
    got = rows.select(T.jaccard(T.trigrams("a"), T.trigrams("b")).alias("x"), T.jaccard(T.trigrams("b"), T.trigrams("a")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [1 / 3, 0.0, 1.0, 0.0]


def test_survival_falls_with_age(spark):
    rows = spark.range(0, 200).select(F.lit("fact").alias("s"), F.col("id").cast("double").alias("age"))
    got = [r.w for r in rows.orderBy("age").select(S.weibull(F.col("s"), F.col("age"), F.lit(30.0)).alias("w")).collect()]
    assert got[0] == 1.0 and all(a >= b for a, b in zip(got, got[1:]))


def test_session_log(spark, tmp_path):
    lines = [{"type": "message", "message": {"role": "user", "content": "a long enough text"}}, {"type": "other"}, {"type": "message", "message": {"role": "assistant", "content": json.dumps([{"text": "part one is here"}])}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = tables.session_log(spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in got) == ["a long enough text", "part one is here"]


def test_updates_and_archive(spark):
    base = spark.createDataFrame([(1, "a", "fact"), (2, "b", "fact")], "memory_id int, content string, scope string")
    got = sinks.updated(base, spark.createDataFrame([(2, "c")], "memory_id int, content string"), "memory_id").orderBy("memory_id").collect()
    assert [r.content for r in got] == ["a", "c"]
    got = sinks.archived(base, "memory_id = 1", 1).orderBy("memory_id").collect()
    assert [(r.scope, r.raw_content) for r in got] == [("archived", "a"), ("fact", None)]
    assert sinks.inserted_if_absent(base, base, ["memory_id"]).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = streaming.topic_windows(streaming.event_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("topics").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streaming.topic_windows(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("topics").collect())) == sorted(map(tuple, batch.collect()))


def test_succession_keeps_every_word_of_the_next_turn(spark):
    one, two = (" ".join(f"{c}{chr(97 + k)}" for k in range(15)) for c in "xy")
    turns = spark.createDataFrame([(1, 1, one), (1, 2, f"{two} ya")], "conv_id int, turn int, text string")
    got = {(r.word, r.next_word): r.n for r in stats.succession(turns, "conv_id", "turn", "text").collect()}
    assert got == {(a, b): 1 for a in one.split()[:10] for b in two.split()}


def test_spreading_passes_on_all_that_was_gathered(spark):
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "e", 0.01), ("e", "f", 1.0), ("d", "a", 0.5), ("b", "b", 0.3)]
    edges = spark.createDataFrame([(*r, "uses", False) for r in rows] + [("a", "z", 9.0, "uses", True)], "source string, target string, weight double, type string, invalid boolean")
    held = {"a": 1.0}
    for _ in range(3):
        now = dict(held)
        for s, t, w in rows:
            for x, y in {(s, t), (t, s)}:
                if held.get(x, 0) >= 0.01:
                    now[y] = now.get(y, 0) + 0.5 * held[x] * w
        held = now
    got = {r.node: r.activation for r in graph.spreading(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert set(got) == set(held) and all(abs(got[k] - held[k]) < 1e-12 for k in held)


def test_walks_on_a_cyclic_graph(spark):
    """Breadth first by the order of edges, causes over the first edge that reaches a node, ranks without invalid ends."""
    rows = [(1, "a", "b", "caused_by", 2.0, 0.5, False), (2, "c", "a", "caused_by", None, None, False), (3, "d", "a", "learned_from", 9.0, 1.0, False), (4, "d", "c", "caused_by", 1.0, 1.0, False), (5, "a", "c", "depends_on", 1.0, 1.0, False), (6, "e", "d", "caused_by", 1.0, 0.9, False), (7, "x", "a", "caused_by", 5.0, 1.0, True), (8, "a", "a", "caused_by", 1.0, 1.0, False), (9, "f", "a", "uses", 1.0, 1.0, False)]
    edges = spark.createDataFrame(rows, "ord long, source string, target string, type string, weight double, confidence double, invalid boolean").withColumn("age_days", F.lit(0.0))
    start = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.hop, r.type, round(r.strength, 9)) for r in graph.causal_chain(edges, start, up=True).collect()}
    assert got == {"c": (1, "caused_by", 0.7), "d": (1, "learned_from", 9.0), "e": (2, "caused_by", 0.45)}
    walked = [r.node for r in graph.breadth_first(graph.both_ways(edges).withColumn("value", F.lit(0.0)), start, 2, 4).orderBy("hop", "path").collect()]
    assert walked == ["b", "c", "d", "f"]
    names = spark.createDataFrame([(x, x == "b") for x in "abcdef"], "name string, invalid boolean")
    ranks = {r.node: r.rank for r in graph.personalized_pagerank(graph.rank_edges(edges, names), start).collect()}
    out = {}
    for _, s, t, kind, w, c, gone in rows:
        if not gone and {s, t} <= set("acdef"):
            out.setdefault(s, []).append((t, (1.0 if w is None else w) * (0.7 if c is None else c) * graph.TYPE_WEIGHTS[kind]))
    held = {"a": 1.0}
    for _ in range(20):
        now = {"a": 0.15}
        for n, r in held.items():
            for t, w in out.get(n, []):
                now[t] = now.get(t, 0) + 0.85 * r * w / sum(x for _, x in out[n])
        held = now
    assert set(ranks) == set(held) and all(abs(ranks[k] - held[k]) < 1e-12 for k in held)


def test_cjk_terms_count(spark):
    rows = spark.createDataFrame([(1, 1, "喜欢咖啡 ok ok"), (1, 2, "咖啡 是的 喜欢咖啡")], "conv_id int, turn int, text string")
    got = rows.orderBy("turn").select(T.all_tokens("text").alias("a"), T.scoring_terms("text").alias("s"), T.overlap_words("text").alias("o")).collect()
    assert got[0].a == ["喜欢", "欢咖", "咖啡", "喜欢咖啡", "ok", "ok"] and got[0].s == ["喜欢", "欢咖", "咖啡", "喜欢咖", "欢咖啡", "ok", "ok"]
    assert got[1].s == ["咖啡", "喜欢", "欢咖", "咖啡", "喜欢咖", "欢咖啡"] and got[1].o == ["咖啡", "是的", "喜欢咖啡"]
    assert ("咖啡", "咖啡") in {(r.word, r.next_word) for r in stats.succession(rows, "conv_id", "turn", "text").collect()}
    assert ("喜欢", "欢咖") in {(r.w1, r.w2) for r in stats.ppmi(rows, "turn", "text").collect()}
    best = recall.dirichlet(rows, spark.createDataFrame([(1, "咖啡")], "query_id int, term string"), "turn", "text").collect()
    assert [(r.turn, r["rank"]) for r in best] == [(2, 1), (1, 2)]
