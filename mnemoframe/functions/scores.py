"""Decay, evidence and weighting formulas: Column -> Column. Ages are in days; the current time is always the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def base_activation(recalls: Column, created_days: Column, accessed_days: Column, cap: int = 20) -> Column:
    """ACT-R: accesses spread evenly from creation to the last one, power law of exponent one half, squashed to (0, 1)."""
    n = F.least(F.greatest(recalls, F.lit(1)), F.lit(cap)).cast("int")
    created, last = (F.greatest(c * 86400.0, F.lit(1.0)) for c in (created_days, accessed_days))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.pow(F.greatest(created - F.when(n > 1, i / (n - 1)).otherwise(F.lit(1.0)) * (created - last), F.lit(1.0)), F.lit(-0.5)))
    return 1 / (1 + F.exp(-F.log(total) - 1))


LAMBDAS = {"fact": 30.0, "preference": 90.0, "episode": 14.0}


def effective_lambda(scope: Column, recalls: Column, intensity: Column, default: float = 30.0) -> Column:
    return one_of(scope, LAMBDAS, default) * F.least(1 + 0.15 * recalls, F.lit(3.0)) * (1 + 1.5 * intensity * intensity)


def weibull(scope: Column, age: Column, lam: Column, k: float = 1.2) -> Column:
    """Survival; corrections never decay."""
    return F.when((scope == "correction") | (age <= 0), 1.0).otherwise(F.exp(-F.pow(age / lam, F.lit(k))))


def fsrs_retrievability(elapsed: Column, stability: Column) -> Column:
    return F.when((stability <= 0) | (elapsed <= 0), 1.0).otherwise(1 / (1 + elapsed / (9 * stability)))


def adaptive_retention(age: Column, uses: Column, half_life: float = 90.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - F.pow(F.lit(2.0), -age / half_life)) / (1 + 0.5 * uses)))


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def positive_evidence(a: Column, b: Column, difficulty: Column) -> tuple[Column, Column]:
    """The evidence after a recall that was not corrected; a harder one counts more."""
    return a + 0.3 + 0.7 * difficulty, b


def negative_evidence(a: Column, b: Column, strength: Column) -> tuple[Column, Column]:
    return a, b + 0.5 + 1.5 * strength


def idle_evidence(a: Column, b: Column, days: Column) -> tuple[Column, Column]:
    """The evidence of a row not recalled for so many days."""
    return a, b + F.when(days > 1, F.least(F.lit(0.1), 0.02 * F.log2(days))).otherwise(0.0)


def beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def confidence_tier(a: Column, b: Column) -> Column:
    m = beta_mean(a, b)
    return F.when((m >= 0.85) & (beta_variance(a, b) < 0.02), "verified").when(m >= 0.6, "probable").when(m >= 0.4, "uncertain").otherwise("dubious")


def recall_modifier(a: Column, b: Column) -> Column:
    m = beta_mean(a, b)
    return F.greatest(F.lit(0.3), F.least(F.lit(1.3), 0.5 + 0.5 * m + F.when((beta_variance(a, b) > 0.03) & (m > 0.3), 0.1).otherwise(0.0)))


def wilson_lower(a: Column, b: Column, z: float = 1.96) -> Column:
    n = a + b - 2
    p = (a - 1) / n
    return F.when(n <= 0, 0.0).otherwise((p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))


def tier_weight(access_age: Column, recalls: Column) -> Column:
    return F.when((access_age <= 1) | (recalls >= 5), 1.5).when(access_age <= 7, 1.0).when(access_age <= 30, 0.8).otherwise(0.5)


def temporal_gravity(age: Column) -> Column:
    return F.greatest(F.lit(0.3), F.exp(-age / 90))


def bcm_threshold(activity: Column, base: float = 0.1) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.3), base + 0.5 * (activity - 0.3)))


def fsrs_update(stability: Column, difficulty: Column, rating: Column, elapsed: Column) -> tuple[Column, Column]:
    """New stability and difficulty after a review rated 1 (forgot) to 4 (easy)."""
    # fixed values: weights 8 to 11 of the scheduler
    w8, w9, w10, w11 = 1.49, 0.14, 0.94, 2.18
    good, r = rating >= 3, fsrs_retrievability(elapsed, stability)
    grown = stability * (1 + F.exp(F.lit(w8)) * (11 - difficulty * 10) * F.pow(stability, F.lit(-w9)) * (F.exp((1 - r) * w10) - 1))
    shrunk = stability * F.pow(F.lit(w11), difficulty * 10 - 1)
    step = F.when(good, -0.02 * (rating - 2)).otherwise(0.1 * (2 - rating))
    return F.greatest(F.lit(0.1), F.when(good, grown).otherwise(shrunk)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), difficulty + step))


def emotion_resonance(emotion: Column, intensity: Column, mood_then: Column, energy_then: Column, mood: float, alertness: float) -> Column:
    """Half, gated by the distance between the states at writing and now, more for a matching mood and strong emotion; no gate without a mood at writing."""
    far = F.sqrt(F.pow(mood - mood_then, F.lit(2)) + F.pow(alertness - F.coalesce(F.nullif(energy_then, F.lit(0.0)), F.lit(0.5)), F.lit(2)))
    gate = F.when(mood_then.isNull(), 1.0).otherwise(F.greatest(F.lit(0.2), 1 / (1 + F.exp(far * 3 - 1.5))))
    match = F.when((F.lit(mood) > 0.3) & (emotion == "warm") | (F.lit(mood) < -0.3) & (emotion == "painful"), 1.4).otherwise(1.0)
    return F.least(F.lit(1.0), 0.5 * gate * match * (1 + 0.5 * F.coalesce(intensity, F.lit(0.0))))


def range_closeness(t: Column, start: Column, end: Column) -> Column:
    """1 within the range, falling to 0 over its own length outside; an empty range counts as a day."""
    span = F.when(end == start, 86400.0).otherwise(end - start)
    return F.when(t.between(start, end), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(t - start), F.abs(t - end)) / span))
