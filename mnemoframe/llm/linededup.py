"""Line dedup by pairwise alignment.

Each document becomes its sequence of line hashes and its minimal runs: from each line on, and back from each line, the fewest
consecutive lines with ``min_block_words`` words. A run that several documents hold links each later document to the earliest
holder, so a run of any frequency gives a number of pairs in proportion to its rows, never all pairs. The hash sequences of a pair
are aligned by patience diff; runs of aligned lines with at least ``min_block_words`` words are deleted from the later document,
and so are shared runs that the alignment passes over because they stand in another order. Each line of a repeated block lies in
a minimal run within the block, so exactly the lines go that lie in a block of consecutive lines of enough words which an earlier
document holds too, however common each line is. Line hashes are taken from the original texts, so one deletion never hides another.

Defined cases: documents are ordered by doc_id, those of equal doc_id by a hash of the text; rows equal in both are one document
and lose the same lines; rows with null doc_id, null or empty texts are returned as they are. Lines
are equal if their words are. Empty tables give empty results; every other column is kept as it is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import mix, row_chunks, stored, text_buffer

BLANK = 0
GROUP_ROWS = 256
_BASE = 0x9E3779B97F4A7C15


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line; 0 and 0 for a line without words."""
    hashes, counts = [], []
    for line in text.encode().split(b"\n"):
        words = line.split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else BLANK)
        counts.append(len(words))
    return hashes, counts


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs rising in both; pairs come ordered by the first."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b). Where no line is unique in both, the n-th occurrences of equal lines are anchors."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        in_a, in_b = Counter(a[i:i2]), Counter(b[j:j2])
        where = {b[k]: k for k in range(j, j2) if in_b[b[k]] == 1}
        anchors = [(k, where[a[k]]) for k in range(i, i2) if in_a[a[k]] == 1 and a[k] in where]
        if not anchors:
            seen: Counter = Counter()
            nth = {}
            for k in range(j, j2):
                nth[b[k], seen[b[k]]] = k
                seen[b[k]] += 1
            seen = Counter()
            for k in range(i, i2):
                if (at := nth.get((a[k], seen[a[k]]))) is not None:
                    anchors.append((k, at))
                seen[a[k]] += 1
            out += _rising(anchors)
            continue
        last = (i - 1, j - 1)
        for x, y in _rising(anchors):
            out.append((x, y))
            todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
        todo.append((last[0] + 1, i2, last[1] + 1, j2))
    return sorted(out)


def minimal_runs(hashes: list[int], words: list[int], min_block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of the shortest runs of enough words from each line on and back from each line."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    least = max(1, min_block_words)
    ahead, back = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, "right") - 1
    from_line, to_line = np.flatnonzero(ahead <= n), np.flatnonzero(back >= 0)
    spans = np.unique(np.concatenate([from_line * (n + 1) + ahead[from_line], back[to_line] * (n + 1) + to_line + 1]))
    first, end = spans // (n + 1), spans % (n + 1)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]))
        under = np.cumprod(np.concatenate([one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.array(hashes, np.int64).view(np.uint64) + np.uint64(_BASE)) * power[:-1])])
        keys = mix((sums[end] - sums[first]) * under[first] + (end - first).astype(np.uint64))
    return first, end, keys.view(np.int64)


def shared_runs(a: list[int], b: list[int], words_b: list[int], min_block_words: int) -> list[int]:
    """Lines of b in minimal runs that a holds too, in whatever order."""
    known = dict(zip(b, words_b))
    _, _, held = minimal_runs(a, [known.get(h, 1) for h in a], min_block_words)  # a run with a line that b lacks meets none of b
    first, end, keys = minimal_runs(b, words_b, min_block_words)
    hit = np.isin(keys, held)
    cover = np.zeros(len(b) + 1, np.int64)
    np.add.at(cover, first[hit], 1)
    np.add.at(cover, end[hit], -1)
    return np.flatnonzero(np.cumsum(cover)[:-1] > 0).tolist()


def common_lines(a: list[int], b: list[int], words_b: list[int], min_block_words: int) -> list[int]:
    """Lines of b in aligned blocks of enough words, and in shared runs that cross the alignment."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words_b[k] for k in block) >= min_block_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out if len(out) == len(b) else sorted({*out, *shared_runs(a, b, words_b, min_block_words)})


def lists_of(column: pa.Array) -> Iterator[list[int]]:
    """The lists of a column in turn, so that only one is held as Python numbers; a null is an empty list."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield values[a:b].tolist()


def removed_lines(docs: DataFrame, min_block_words: int = 20) -> DataFrame:
    """(key, removed: sorted indices of lines to delete) for documents that lose any."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                rows = [line_hashes(t or "") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["key", "hashes", "words"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(minimal_runs(h, w, min_block_words)[2]) for h, w in zip(lists_of(batch.column(1)), lists_of(batch.column(2)))]
            if found:
                of = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.concatenate(found))], names=["key", "run"])

    rows = docs.where("doc_id is not null and text is not null").select(F.struct("doc_id", F.xxhash64("text").alias("version")).alias("key"), "text")
    key = "struct<doc_id:bigint,version:bigint>"
    lines = stored(rows.mapInArrow(hashed, f"key {key}, hashes array<long>, words array<int>").groupBy("key").agg(F.any_value("hashes").alias("hashes"), F.any_value("words").alias("words")), "lines")
    held = lines.select("key", "hashes", "words").mapInArrow(runs, f"key {key}, run long")
    first = held.groupBy("run").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first")
    pairs = stored(held.join(first, "run").where(F.col("key") > F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    # a holder's lines stand once before those of at most about GROUP_ROWS later documents, never once for each of them
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("n"))
    later = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), "b").join(lines.withColumnRenamed("key", "b"), "b")
    holders = groups.join(lines.withColumnRenamed("key", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(None).cast(key).alias("b"), "hashes", F.lit(None).cast("array<int>").alias("words"))
    sides = holders.unionByName(later).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).select("b", "hashes", "words")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder: list[int] = []
        for batch in batches:
            keep, gone = [], []
            follows = pc.is_valid(batch.column(0)).to_pylist()
            for k, (hashes, words) in enumerate(zip(lists_of(batch.column(1)), lists_of(batch.column(2)))):
                if not follows[k]:
                    holder = hashes
                elif found := common_lines(holder, hashes, words, min_block_words):
                    keep.append(k)
                    gone.append(np.array(found, np.int32))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(gone, pa.list_(pa.int32()))], names=["key", "removed"])

    found = sides.mapInArrow(aligned, f"key {key}, removed array<int>")
    return found.select("key", F.explode("removed").alias("line")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("removed"))


STATS = ("n_lines", "n_removed", "removed_words")


def _cut(docs: DataFrame, min_block_words: int, stats: bool, drop_emptied: bool) -> DataFrame:
    removed = removed_lines(docs, min_block_words)
    names = [c for c in docs.columns if not stats or c not in STATS]
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of docs meets one of this join
    wide = rows.join(removed, (F.col("row.doc_id") == F.col("key.doc_id")) & (F.xxhash64("row.text") == F.col("key.version")), "left")
    own = [F.col("row")[c].alias(c) for c in names]
    schema = docs.select(*names, *[F.lit(0).cast("long").alias(c) for c in STATS if stats]).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(text_at))
            for lo, hi in row_chunks(offsets):
                yield shortened(batch.slice(lo, hi - lo))

    def shortened(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns[: len(names)])
        texts = columns[text_at].to_pylist()
        keep = np.ones(len(batch), bool)
        measured = [[t.count("\n") + 1 if t is not None else 0 for t in texts], [0] * len(texts), [0] * len(texts)]
        sizes = columns[size_at].to_pylist() if size_at >= 0 else None
        for k, gone in enumerate(batch.column(len(names)).to_pylist()):
            if not gone:
                continue
            lines, drop = texts[k].split("\n"), set(gone)
            measured[1][k], measured[2][k] = len(drop), sum(len(lines[j].encode().split()) for j in drop)
            texts[k] = "\n".join(x for j, x in enumerate(lines) if j not in drop)
            keep[k] = not drop_emptied or bool(texts[k].encode().split())
            if sizes:
                sizes[k] = len(texts[k])
        columns[text_at] = pa.array(texts, pa.string())
        if sizes:
            columns[size_at] = pa.array(sizes, columns[size_at].type)
        if stats:
            columns += [pa.array(x, pa.int64()) for x in measured]
        return pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return wide.select(*own, "removed").mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, min_block_words: int = 20) -> DataFrame:
    """``docs`` with the shortened text (n_chars, if there, follows it), then n_lines, n_removed (lines) and removed_words.

    Columns of docs with those three names are replaced.
    """
    return _cut(docs, min_block_words, stats=True, drop_emptied=False)


def without_repeated_blocks(docs: DataFrame, min_block_words: int = 20) -> DataFrame:
    """``docs`` with the shortened text and n_chars, all columns kept; documents that lose their last word go."""
    return _cut(docs, min_block_words, stats=False, drop_emptied=True)
