"""Samples by moments and independence of partitioning; beliefs against a fold."""

import math
import random

from pyspark.sql import functions as F

from mnemoframe.functions import sampling
from mnemoframe.operators import bandit


def test_moments_and_partitions(spark):
    rows = spark.range(4000).withColumn("seed", F.concat(F.lit("s"), "id"))
    drawn = lambda df: df.select("id", sampling.uniform(F.col("seed"), F.lit(0)).alias("u"), sampling.normal(F.col("seed"), F.lit("0")).alias("z"), sampling.gamma(F.lit(3.5), F.col("seed")).alias("g"), sampling.gamma(F.lit(0.4), F.col("seed")).alias("h"), sampling.beta(F.lit(2.0), F.lit(6.0), F.col("seed")).alias("b"))
    got = drawn(rows).collect()
    for name, mean, var in (("u", 0.5, 1 / 12), ("z", 0, 1), ("g", 3.5, 3.5), ("h", 0.4, 0.4), ("b", 0.25, 12 / 64 / 9)):
        values = [r[name] for r in got]
        m = sum(values) / len(values)
        assert abs(m - mean) < 5 * math.sqrt(var / len(values)), name
        assert abs(sum((v - m) ** 2 for v in values) / len(values) - var) < 0.2 * var, name
    assert all(0 < r.u < 1 and r.g > 0 and r.h > 0 and 0 < r.b < 1 for r in got) and len({r.u for r in got}) == 4000
    assert sorted(map(tuple, drawn(rows.repartition(7, "seed")).collect())) == sorted(map(tuple, got))
    assert rows.limit(1).select(sampling.gamma(F.lit(-1.0), F.col("seed"))).first()[0] is not None


def test_beliefs_against_a_fold(spark):
    rng = random.Random(4)
    rewards = [(rng.choice("pq"), rng.randrange(4), k, rng.choice([None, 0.0, 0.3, 1.0])) for k in range(200)]
    arms = [(p, a, 1.0 + a, 2.0) for p in "pqr" for a in range(3)]
    want = {(p, a): [x, y, 0] for p, a, x, y in arms}
    for p, a, _, r in rewards:
        if r is not None and (p, a) in want:
            t = want[p, a]
            t[0], t[1], t[2] = (t[0] + r * 5) * 0.995, (t[1] + (1 - r) * 5) * 0.995, t[2] + 1
            assert t[0] + t[1] >= 2  # so the floor of the beliefs is never met
    frame = spark.createDataFrame(arms, "param string, arm int, alpha double, beta double")
    after = bandit.updated_arms(frame, spark.createDataFrame(rewards, "param string, arm int, at int, reward double"), ["at"])
    got = {(r.param, r.arm): (r.alpha, r.beta, r.pulls) for r in after.collect()}
    assert set(got) == set(want) and all(math.isclose(x, y, rel_tol=1e-9) for k in got for x, y in zip(got[k], want[k]))
    # over many draws the better arm is chosen more often, and a draw gives the same choice again
    sure = spark.createDataFrame([("p", 0, 2.0, 8.0), ("p", 1, 8.0, 2.0)], "param string, arm int, alpha double, beta double")
    draws = [bandit.chosen_arms(sure, F.lit(str(k))).first().arm for k in range(12)]
    assert sum(draws) >= 10 and draws[:3] == [bandit.chosen_arms(sure, F.lit(str(k))).first().arm for k in range(3)]
