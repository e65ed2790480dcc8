"""Benchmark decontamination by the q-gram lemma.

A benchmark passage of m characters that stands in a document with at most k edits shares at least t = m - q + 1 - k*q of its
q-grams with it, all on diagonals (document position minus passage position) within k of each other. Shared q-grams are counted
per passage in diagonal bands of k + 1, two neighbouring bands together, so bands overlap and no such occurrence is split. Bands
that reach t are verified by banded alignment of the whole passage.

Texts are compared in lower case with runs of white space as one space; k is ``edit_percent`` % of m, less for short passages so
that t stays positive. Passages under two q-grams are searched as exact substrings. The benchmark is sent to the tasks in blocks
of at most ``block_chars`` characters (plus one passage); a larger benchmark takes more passes over the documents.

Defined cases: null and empty texts match nothing; null and empty passages are matched by nothing; repeated document rows give
repeated results; equal passages each give a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import mix, row_chunks, text_buffer

SCHEMA = "doc_id long, item_id long, start long, end long, edits int, shared_qgrams long"
_P = 0x100000001B3
FILTER_BITS = 20


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q code points, by doubling."""
    with np.errstate(over="ignore"):
        part, width, out, done = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, None, 0
        while width <= q:
            if q & width:
                tail = part[done:] if done else part
                if out is None:
                    out = tail
                else:
                    n = min(len(out), len(tail))
                    out = out[:n] * np.uint64(pow(_P, width, 1 << 64)) + tail[:n]
                done += width
            part = part[: max(0, len(part) - width)] * np.uint64(pow(_P, width, 1 << 64)) + part[width:]
            width *= 2
    return mix(out[: max(0, len(code) - q + 1)])


@dataclass
class Index:
    """q-grams of a block of passages: ``grams`` sorted and distinct, its postings at first[g]..first[g + 1]."""

    q: int
    ids: list[int]
    texts: list[str]
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    short: list[int]


def build_index(items: list[tuple[int, str]], q: int, edit_percent: int) -> Index:
    ids, texts = [i for i, _ in items], [normalised(t) for _, t in items]
    size = np.array([len(t) for t in texts], np.int64)
    budget = np.maximum(0, np.minimum(size * edit_percent // 100, (size - q) // q))
    grams, item, place, short = [], [], [], []
    for k, text in enumerate(texts):
        if len(text) < 2 * q:
            short.append(k)
            continue
        h = gram_hashes(codes(text), q)
        grams.append(h)
        item.append(np.full(len(h), k))
        place.append(np.arange(len(h)))
    none = [np.zeros(0, np.int64)]
    gram = np.concatenate(grams or [np.zeros(0, np.uint64)])
    order = np.argsort(gram, kind="stable")
    distinct, first = np.unique(gram[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(distinct >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(q, ids, texts, budget, size - q + 1 - budget * q, distinct, np.append(first, len(gram)), np.concatenate(item or none)[order], np.concatenate(place or none)[order], maybe, short)


def within_budget(item: np.ndarray, window: np.ndarray, budget: int) -> bool:
    """Whether the whole item has a place in the window with at most ``budget`` edits: the band without its origins, left early."""
    m, n = len(item), len(window)
    band = n - m + 2 * budget + 1
    if band <= 0:
        return False
    big = m + n
    padded = np.full(n + 2 * (m + budget) + 2, 0xFFFFFFFF, np.uint32)
    padded[budget + 1 : budget + 1 + n] = window  # column c is at c + budget
    now = np.full(band + 1, big)  # one more, for what lies right of the band
    now[budget : budget + n + 1] = 0
    now[band] = big
    ramp = np.arange(band)
    for i in range(1, m + 1):
        best = np.minimum(now[:-1] + (padded[i : i + band] != item[i - 1]), now[1:] + 1)
        if i < budget:
            best[: budget - i] = big
        best[n - i + budget + 1 :] = big
        now[:-1] = np.minimum.accumulate(best - ramp) + ramp
        if not i & 7 and now.min() > budget:
            return False
    return bool(now.min() <= budget)


def banded_distance(item: np.ndarray, window: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole item in the window if it needs at most ``budget`` edits.

    Rows are the item's characters, columns the window's ends; only diagonals that the window allows are held, which is the band.
    """
    m, n = len(item), len(window)
    band = n - m + 2 * budget + 1  # diagonals -budget .. n - m + budget
    if band <= 0:
        return None
    shift = np.arange(band) - budget  # column minus row
    big = m + n
    now = np.where((shift >= 0) & (shift <= n), 0, big)
    origin = shift.copy()
    ramp = np.arange(band)
    for i in range(1, m + 1):
        column = shift + i
        inside = (column >= 1) & (column <= n)
        same = np.zeros(band, bool)
        same[inside] = window[column[inside] - 1] == item[i - 1]
        step = now + np.where(inside, ~same, big)
        up = np.append(now[1:], big) + 1
        from_up = up < step
        best = np.where((column >= 0) & (column <= n), np.minimum(step, up), big)
        source = np.where(from_up, np.append(origin[1:], 0), origin)
        run = np.minimum.accumulate(best - ramp)
        keep = np.maximum.accumulate(np.where(best - ramp == run, ramp, 0))
        now, origin = run + ramp, source[keep]
    k = int(now.argmin())
    return (int(now[k]), max(0, int(origin[k])), int(shift[k]) + m) if now[k] <= budget else None


def matches(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, start, end, edits, shared q-grams): the best place of each passage in each normalised text that has one."""
    q = index.q
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = codes("\0".join(texts))
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    if len(index.grams) and len(joined) >= q:
        h = gram_hashes(joined, q)
        at = np.flatnonzero(index.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
        good = index.grams[gram] == h[at]
        at, gram = at[good], gram[good]
        size = index.first[gram + 1] - index.first[gram]
        ends = np.cumsum(size)
        post = np.arange(size.sum()) + np.repeat(index.first[gram] - (ends - size), size)
        at = np.repeat(at, size)
        item, place = index.item[post], index.place[post]
        row = np.searchsorted(starts, at, "right") - 1
        diagonal = at - starts[row] - place + len(joined)  # made positive
        band = diagonal // (index.budget[item] + 1)
        most = int(band.max(initial=0)) + 2
        key, count = np.unique((row * len(index.texts) + item) * most + band, return_counts=True)
        following = np.zeros_like(count)
        following[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        pair, band = key // most, key % most
        row, item = pair // len(index.texts), pair % len(index.texts)
        for r, k, b, c in zip(*(x[count + following >= index.least[item]] for x in (row, item, band, count + following))):
            r, k = int(r), int(k)
            text, passage, budget = texts[r], index.texts[k], int(index.budget[k])
            if (r, k) in found and found[r, k][2] == 0:
                continue
            lo = int(b) * (budget + 1) - len(joined)
            hi = lo + 2 * (budget + 1) + len(passage) + budget
            lo, hi = max(0, lo - budget), min(len(text), hi)
            exact = text.find(passage, lo, hi)
            hit = (0, exact, exact + len(passage)) if exact >= 0 else None
            if exact < 0 and within_budget(codes(passage), codes(text[lo:hi]), budget):
                hit = banded_distance(codes(passage), codes(text[lo:hi]), budget)
            if hit and exact < 0:
                hit = (hit[0], hit[1] + lo, hit[2] + lo)
            if hit and ((r, k) not in found or hit[0] < found[r, k][2]):
                found[r, k] = (hit[1], hit[2], hit[0], int(c))
    for k in index.short:
        for r, text in enumerate(texts):
            if index.texts[k] and (p := text.find(index.texts[k])) >= 0:
                found[r, k] = (p, p + len(index.texts[k]), 0, 0)
    for (r, k), hit in sorted(found.items()):
        yield r, k, *hit


def benchmark_blocks(benchmark: DataFrame, q: int, edit_percent: int, block_chars: int) -> Iterator[Index]:
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = 1 + 2 * total // block_chars if total > block_chars else 1
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()  # about block_chars / 2 characters
        yield build_index([(r["item_id"], r["text"]) for r in part], q, edit_percent)


def batch_matches(column: pa.Array, index: Index) -> Iterator[tuple]:
    """``matches`` over a column of texts."""
    _, offsets = text_buffer(column)
    for lo, hi in row_chunks(offsets):
        for r, *rest in matches([normalised(x or "") for x in column.slice(lo, hi - lo).to_pylist()], index):
            yield lo + r, *rest


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, edit_percent: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and benchmark passage found in it, with the place in the normalised text and the edits."""
    out = []
    for index in benchmark_blocks(benchmark, q, edit_percent, block_chars):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[r].as_py(), index.ids[k], *rest) for r, k, *rest in batch_matches(batch.column(1), index)]
                cols = list(zip(*rows)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "start", "end", "edits", "shared_qgrams"])

        out.append(docs.select("doc_id", "text").mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionAll, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, edit_percent: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no benchmark passage, all columns kept."""
    at = docs.columns.index("text")
    for index in benchmark_blocks(benchmark, q, edit_percent, block_chars):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, *_ in batch_matches(batch.column(at), index)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
