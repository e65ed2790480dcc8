"""Wording functions on nulls and empty texts; replays over batches of several keys."""

from pyspark.sql import functions as F

from mnemoframe.functions import wording as W
from mnemoframe.operators import style


def test_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    t = F.col("text")
    got = {r.id: r for r in rows.select("id", W.emotion_label(t).alias("e"), W.reason(t).alias("r"), W.dated(t, F.lit("2024-01-01")).alias("d"), W.code_symbols(t).alias("c"), W.stack_frames(t).alias("s")).collect()}
    assert got[1].e.label == got[2].e.label == "neutral" and got[1].r is None and got[2].r is None
    assert got[1].d is None and got[2].d == "" and got[1].s is None and got[2].s is None and not got[2].c


def test_weighted_similarity(spark):
    pairs = spark.createDataFrame([(1, "abcd", "abce"), (2, "", "abc"), (3, None, "abc")], "id int, a string, b string")
    weights = spark.createDataFrame([("abc", 3.0), ("bce", 0.0)], "gram string, weight double")
    got = {r.id: r.similarity for r in style.weighted_similarity(pairs, weights).collect()}
    assert got == {1: 3.0 / 5.0, 2: 0.0, 3: 0.0}
    assert style.weighted_similarity(pairs.limit(0), weights).count() == 0


def test_pressure_rises_and_rests(spark):
    rows = spark.createDataFrame([(k, i, [0.5 if k else -0.1, 0.5 if k else 0.0]) for k in (0, 1) for i in range(12)], "user long, turn int, drive array<double>")
    got = style.pressure(rows, "user", ["turn"]).where("turn = 11").select("user", style.pressure_phase(*[F.col(c) for c in ("frustration", "signal", "stress", "velocity")]).alias("phase"))
    assert {r.user: r.phase for r in got.collect()} == {0: "calm", 1: "critical"}
