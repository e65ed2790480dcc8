"""FNV-1a hashes and locality-sensitive signatures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Offset basis and prime of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
BITS = 64


def fnv1a64_of(words: list[str]) -> np.ndarray:
    """FNV-1a over the UTF-16 units of each word, as signed 64-bit integers; one step of all words at a time."""
    units = [np.frombuffer(w.encode("utf-16-le", "surrogatepass"), np.uint16) for w in words]
    sizes = np.array([len(u) for u in units], np.int64)
    out = np.full(len(words), FNV_OFFSET, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    flat, firsts = (np.concatenate(units) if words else np.zeros(0, np.uint16)).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    falling = -sizes[order]
    for k in range(int(sizes.max(initial=0))):
        rows = order[: np.searchsorted(falling, -k, "left")]  # words of more than k units
        out[rows] = (out[rows] ^ flat[firsts[rows] + k]) * np.uint64(FNV_PRIME)
    return out.view(np.int64)


@F.pandas_udf(LongType())
def fnv1a64(words: pd.Series) -> pd.Series:
    """Null for null."""
    known = words.notna()
    out = pd.Series(np.zeros(len(words), np.int64), index=words.index).astype("Int64")
    out[known] = fnv1a64_of(words[known].tolist())
    out[~known] = pd.NA
    return out


def votes(hashed: Column, weight: Column) -> list[Column]:
    """For each bit the sum of weights of hashes with it less those without, to be used in an aggregation; weights are integers, so any order gives the same."""
    return [F.sum(F.when(F.shiftright(hashed, k).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)).alias(f"v{k}") for k in range(BITS)]


def signature(names: list[str]) -> Column:
    """The bits whose votes are over the 33rd smallest."""
    middle = F.get(F.array_sort(F.array(*names)), BITS // 2)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c) > middle, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k, c in enumerate(names)])


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
