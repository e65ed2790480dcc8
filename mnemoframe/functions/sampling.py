"""Random samples as Column expressions: each is a function of its seed alone, so partitioning, order and retries change nothing.

Uniform numbers come from digests of the seed and a counter. Gamma samples follow Marsaglia and Tsang: up to ``TRIES`` proposals, of
which over 95 % each are taken; that none is has a chance under 1e-20 and gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.chunks import bound

TRIES, LEAST_SHAPE = 16, 0.01


def uniform(seed: Column, counter: Column) -> Column:
    """Between 0 and 1, both excluded, in steps of 2 ** -52."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), counter.cast("string"))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def normal(seed: Column, counter: Column) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, F.concat(counter, F.lit("a"))))) * F.cos(2 * math.pi * uniform(seed, F.concat(counter, F.lit("b"))))


def gamma(shape: Column, seed: Column) -> Column:
    """Of scale 1; shapes under 0.01 count as 0.01, those under 1 come from the next higher one by a power of a uniform number."""
    least = F.greatest(F.lit(LEAST_SHAPE), shape)

    def of(s: Column) -> Column:
        d = F.when(s < 1, s + 1).otherwise(s) - 1 / 3
        none = F.lit(None).cast("double")

        def attempt(k: Column) -> Column:
            x = normal(seed, k.cast("string"))
            return bound(F.struct(x.alias("x"), (1 + x / F.sqrt(9 * d)).alias("w")), lambda t: F.when(t["w"] <= 0, none).otherwise(taken(t["x"], F.pow(t["w"], F.lit(3.0)), uniform(seed, F.concat(k.cast("string"), F.lit("u"))))))

        def taken(x: Column, v: Column, u: Column) -> Column:
            return F.when((u < 1 - 0.0331 * F.pow(x, F.lit(4.0))) | (F.log(u) < 0.5 * x * x + d * (1 - v + F.log(v))), d * v)

        found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), none, lambda acc, k: F.when(acc.isNotNull(), acc).otherwise(attempt(k)))
        return found * F.when(s < 1, F.pow(uniform(seed, F.lit("p")), 1 / s)).otherwise(1.0)

    return bound(least, of)


def beta(a: Column, b: Column, seed: Column) -> Column:
    """From two gamma samples."""
    one, two = gamma(a, F.concat(seed.cast("string"), F.lit("x"))), gamma(b, F.concat(seed.cast("string"), F.lit("y")))
    return bound(F.struct(one.alias("x"), two.alias("y")), lambda s: s["x"] / (s["x"] + s["y"]))
