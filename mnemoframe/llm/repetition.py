"""Quality rules with a suffix-array repetition measure.

A suffix array over each text's words (prefix doubling over many texts at once) gives the longest common prefix of neighbouring
suffixes. The larger of a suffix's two neighbour values is the value of the deepest LCP interval that holds it, so it is the
length of the longest repeated substring beginning there; the union of those of at least ``min_repeat_words`` words is the union
of all occurrences of maximal repeats of that length. Its share of the text's word characters and the longest repeat are limited.
Words of more than ``LONG_WORD`` characters, as in text without spaces, are taken apart: each of their characters begins a suffix and
counts as 1 / ``CHARS_A_WORD`` of a word; such a character never equals a word of its own.

Defined cases: null and empty texts have zero counts and fail the base rule; equal rows get equal rows; an empty table gives an
empty result; other columns are ignored, whatever their names. A text longer than the chunk size is handled alone, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemoframe.llm.common import Words, row_chunks, text_buffer

SYMBOLS = "#*$%&|<>"
LONG_WORD, CHARS_A_WORD = 40, 6
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_chars long, base_failed boolean, kept boolean"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def longest_repeats(row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring beginning there that occurs again in its row.

    row: nondecreasing row numbers; token: any values equal for equal words.
    """
    n = len(token)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    _, word = np.unique(token, return_inverse=True)
    left = np.append(np.flatnonzero(row[1:] != row[:-1]), n - 1)  # last position of each row
    end = np.repeat(left + 1, np.diff(np.append(-1, left)))
    key = row.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a class is named by the place of its first member
    levels, width = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        ahead = tied + width
        second = np.where(ahead < end[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        sort = np.lexsort((second, rank[tied]))
        tied, second = tied[sort], second[sort]
        old = rank[tied]
        place = np.arange(len(tied))
        new_class = np.append(True, (old[1:] != old[:-1]) | (second[1:] != second[:-1]))
        class_first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        member_first = np.maximum.accumulate(np.where(new_class, place, 0))
        rank[tied] = old + member_first - class_first
        width *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b]) & (row[a] == row[b])
        same = ok.copy()
        same[ok] = (levels[k][x[ok]] == levels[k][y[ok]]) & (x[ok] + (1 << k) <= end[a[ok]]) & (y[ok] + (1 << k) <= end[b[ok]])
        lcp += same.astype(np.int64) << k
    out[b] = lcp
    out[a] = np.maximum(out[a], lcp)
    return out


def _covered(length: np.ndarray) -> np.ndarray:
    """Positions inside the union of [i, i + length[i])."""
    n = len(length)
    at = np.flatnonzero(length)
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + length[at], minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _per_row(w: Words, values: np.ndarray) -> np.ndarray:
    return np.bincount(w.row, weights=values, minlength=w.n_rows).astype(np.int64)


def taken_apart(words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, characters, sixths of a word) of the words of ``rows``, long words as their single characters."""
    at = np.flatnonzero(np.isin(words.row, rows))
    size = np.where(words.n_chars[at] > LONG_WORD, words.n_chars[at], 1)
    unit = np.repeat(np.arange(len(at)), size)  # the word of each unit
    token, chars, weight = words.hash[at][unit], words.n_chars[at][unit], np.full(len(unit), CHARS_A_WORD)
    single = (size > 1)[unit]
    if single.any():
        is_byte = np.zeros(len(words.buf) + 1, np.int64)
        np.add.at(is_byte, words.start[at][size > 1], 1)
        np.add.at(is_byte, (words.start + words.length)[at][size > 1], -1)
        here = np.flatnonzero((np.cumsum(is_byte)[:-1] > 0) & ((words.buf & 0xC0) != 0x80))  # first bytes of characters
        ahead = np.append(words.buf, np.zeros(3, np.uint8)).astype(np.uint64)
        code, more = ahead[here], np.ones(len(here), bool)
        for k in range(1, 4):
            byte = ahead[here + k]
            more &= (byte & np.uint64(0xC0)) == np.uint64(0x80)
            code = np.where(more, code << np.uint64(8) | byte, code)
        token[single], chars[single], weight[single] = code, 1, 1
    return words.row[at][unit], token, chars, weight


def repeats(row: np.ndarray, token: np.ndarray, chars: np.ndarray, weight: np.ndarray, n_rows: int, min_repeat_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the longest repeat in whole words and the characters inside repeats of ``min_repeat_words`` words or more."""
    repeat = longest_repeats(row, token)
    upto = np.concatenate([[0], np.cumsum(weight)])
    words = (upto[np.arange(len(row)) + repeat] - upto[:-1]) // CHARS_A_WORD
    spans = _covered(np.where(words >= min_repeat_words, repeat, 0))
    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, row, words)
    return longest, np.bincount(row, weights=chars * spans, minlength=n_rows).astype(np.int64)


def measure(words: Words, texts: list[str], min_repeat_words: int) -> dict[str, np.ndarray]:
    repeat = longest_repeats(words.row, words.hash)
    window = _covered(np.where(repeat >= 8, 8, 0))
    spans = _covered(np.where(repeat >= min_repeat_words, repeat, 0))
    longest = np.zeros(words.n_rows, np.int64)
    np.maximum.at(longest, words.row, repeat)
    covered = _per_row(words, words.n_chars * spans)
    unspaced = np.unique(words.row[words.n_chars > LONG_WORD])
    if len(unspaced):
        again, inside = repeats(*taken_apart(words, unspaced), words.n_rows, min_repeat_words)
        longest[unspaced], covered[unspaced] = again[unspaced], inside[unspaced]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[words.buf])])
    dups = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dups.append(len(lines) - len(set(lines)))
    return {
        "n_words": words.counts.astype(np.int64), "word_chars": _per_row(words, words.n_chars), "n_symbols": symbols[words.offsets[1:]] - symbols[words.offsets[:-1]],
        "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": _per_row(words, window), "longest_repeat": longest, "covered_chars": covered,
    }


def quality_rules(docs: DataFrame, min_repeat_words: int = 8, max_covered_percent: int = 25, max_longest_words: int = 200) -> DataFrame:
    """One row per document: base counts, the repetition measures, ``base_failed`` and ``kept``.

    kept: not base_failed, covered characters at most ``max_covered_percent`` % of word characters, and no repeat over
    ``max_longest_words`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                texts = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                m = measure(Words(data, offsets, lo, hi), texts, min_repeat_words)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                good = ~failed & (100 * m["covered_chars"] <= max_covered_percent * m["word_chars"]) & (m["longest_repeat"] <= max_longest_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, m.values()), pa.array(failed), pa.array(good)], names=["doc_id", *m, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
