"""Thompson sampling over arms with discounted Beta beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import sampling

# What a reward weighs, and what is kept of a belief at each reward.
REWARD_SCALE, DISCOUNT = 5.0, 0.995


def updated_arms(arms: DataFrame, rewards: DataFrame, order: list[str]) -> DataFrame:
    """(param, arm, alpha, beta, pulls) after the rewards (param, arm, reward 0..1), each arm's in ``order``.

    A reward r adds 5r to alpha and 5(1 - r) to beta, then both keep 0.995. As each adds 5 in sum, no belief falls so low that it would be
    lifted, so the fold is a sum with powers of the discount, each reward by its place from the last: one window over an arm's rewards.
    Null rewards don't count; rewards of unknown arms go. arms: (param, arm, alpha, beta).
    """
    place = F.row_number().over(Window.partitionBy("param", "arm").orderBy(*[F.desc(c) for c in order]))
    faded = rewards.where("reward is not null").withColumn("_w", F.pow(F.lit(DISCOUNT), place.cast("double")))
    sums = faded.groupBy("param", "arm").agg(F.sum(F.col("reward") * F.col("_w")).alias("_won"), F.sum((1 - F.col("reward")) * F.col("_w")).alias("_lost"), F.count("*").alias("_n"))
    kept = F.pow(F.lit(DISCOUNT), F.coalesce("_n", F.lit(0)).cast("double"))
    grown = lambda c, gain: (F.col(c) * kept + REWARD_SCALE * F.coalesce(gain, F.lit(0.0))).alias(c)
    return arms.join(sums, ["param", "arm"], "left").select("param", "arm", grown("alpha", "_won"), grown("beta", "_lost"), F.coalesce("_n", F.lit(0)).alias("pulls"))


def chosen_arms(arms: DataFrame, draw: Column) -> DataFrame:
    """(param, arm, sample): of each param the arm of the greatest sample of its belief; the seed is param, arm and ``draw``."""
    drawn = arms.withColumn("sample", sampling.beta(F.greatest(F.lit(0.01), F.col("alpha")), F.greatest(F.lit(0.01), F.col("beta")), F.concat_ws(":", "param", "arm", draw)))
    best = drawn.groupBy("param").agg(F.max(F.struct("sample", (-F.col("arm")).alias("first"))).alias("best"))
    return best.select("param", (-F.col("best.first")).alias("arm"), "best.sample")
