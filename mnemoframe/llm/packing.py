"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

How many sequences are needed depends on lengths alone, and those are 1 to ``capacity``: so the driver gets ``capacity`` counts
at most, whatever the corpus holds. Lengths over a third of the capacity pair at most twice in a sequence: the longest is matched
with the longest that still fits, greedily. Shorter ones then go, longest first, where the remaining gap fits best. Sequences
with equal content are planned as one group with a multiplicity. The plan says which ranks of each length go where; ranks are
found by counting per (length, bucket), so no length, however frequent, is sorted in one task.

Defined cases: a null text is an empty one; an empty text still holds the end token. A document over the capacity is cut into
full pieces and a last one. Repeated rows are packed as often as they occur. An empty table gives an empty result; other columns
are ignored. Rows of null doc_id are packed like others.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import LOWER, give_back, row_chunks, stored, text_buffer

CAPACITY = 4096
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE_WORDS = 50_000
CACHE_PARTS = 200_000
LINE_PARTS = 2_000
BLOCK_BYTES = 1 << 20


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


class Pool:
    """Lists of ids under running numbers, in two arrays that double when they are full."""

    def __init__(self) -> None:
        self.ids, self.first, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        used, n = int(self.first[self.n]), self.n + len(sizes)
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.first[self.n + 1 : n + 1] = used + np.cumsum(sizes)
        self.ids[used : used + len(ids)] = ids
        self.n = n

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the lists of these numbers, and the lists one after another."""
        first = self.first[numbers]
        size = self.first[numbers + 1] - first
        return size, self.ids[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]


# The normaliser and pre-tokenizer that the memory of parts is right for.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [{"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

SPACE, LETTER, NUMBER, SYMBOL, ODD = range(5)


def kinds() -> np.ndarray:
    """Kind of each character up to U+00FF by the expression above. Control characters, other spaces and the soft hyphen are odd."""
    out = np.full(256, ODD, np.uint8)
    for x in range(256):
        kind = unicodedata.category(chr(x))
        if x in b" \t\n\v\f\r":
            out[x] = SPACE
        elif kind[0] in "LNPS":
            out[x] = {"L": LETTER, "N": NUMBER}.get(kind[0], SYMBOL)
    return out


KINDS = kinds()
BYTE_KINDS = np.where(np.arange(256) < 128, KINDS, ODD).astype(np.uint8)
BYTE_KINDS[0x80:0xC0] = SYMBOL  # replaced by the kind of the whole character
BYTE_KINDS[[0xC2, 0xC3]] = SYMBOL


def kinds_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each byte's character, the buffer in lower case, and where the second bytes of characters lie."""
    kind, lower = BYTE_KINDS[buf], LOWER[buf]
    lead = np.flatnonzero((buf | 1) == 0xC3)
    if len(lead):
        second = buf[lead + 1]
        char = ((buf[lead] & 3) << 6) | (second & 63)
        kind[lead] = kind[lead + 1] = KINDS[char]
        lower[lead + 1] = second + np.where((char >= 0xC0) & (char <= 0xDE) & (char != 0xD7), 32, 0).astype(np.uint8)
    return kind, lower, lead + 1


class ChunkTokenizer:
    """Ids of whole texts through a memory of the ids of their parts.

    Texts of ASCII and Latin-1 characters are cut into lower-case parts as the pre-tokenizer does, a block at a time, and only unknown
    parts go through the BPE model. As the pre-tokenizer never joins characters over white space, another text's ids are those of its
    white-space separated chunks in turn: those of such characters are cut likewise, the others go through the whole tokenizer and
    have a memory of their own. A full memory keeps what the block at hand holds. A tokenizer file with another normaliser,
    pre-tokenizer, post-processor or white space in a special token encodes whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        special = [x["content"] for x in made["added_tokens"]]
        self.chunked = (
            (made["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (made["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS
            and not made["post_processor"] and made["model"]["type"] == "BPE"
            and all(x.startswith("<|") and not any(map(str.isspace, x)) for x in special)
        )
        self.tokenize = self.tokenizer.model.tokenize
        self.by_line = Tokenizer(self.tokenizer.model)  # the model alone
        self.by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        suffix, vocab = made["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(False)
        self.is_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.is_end[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on; a line feed parts the parts
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.alphabet = "".join(chr(x) if x in {*shown, 10} else chr(256 + hidden.index(x)) for x in range(256))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lists = Pool()
        self.known_odd: dict[str, int] = {}
        self.odd_lists = Pool()

    def _model_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and the ids one after another."""
        lines = ["\n".join(parts[k : k + LINE_PARTS]) for k in range(0, len(parts), LINE_PARTS)]
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(self.alphabet) for x in lines]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.by_line.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != len(parts):  # a model whose ids do not tell where a part ends
            return flat([[x.id for x in self.tokenize(p)] for line in lines for p in line.split("\n")])
        return np.diff(ends, prepend=-1), ids

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The number in ``lists`` of each of these different parts."""
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) + len(new) > CACHE_PARTS:
                old = np.flatnonzero(at >= 0)
                kept = self.lists.get(at[old])
                self.known, self.lists = dict(zip(map(parts.__getitem__, old.tolist()), range(len(old)))), Pool()
                self.lists.add(*kept)
                at[old] = np.arange(len(old))
            unknown = list(map(parts.__getitem__, new.tolist()))
            at[new] = np.arange(self.lists.n, self.lists.n + len(new))
            self.known.update(zip(unknown, at[new].tolist()))
            self.lists.add(*self._model_ids(unknown))
        return at

    def _cut(self, kind: np.ndarray, lower: np.ndarray, second: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text without odd characters, and the ids one after another."""
        size = len(kind)
        heads = np.zeros(size + 3, bool)  # where texts begin
        heads[offsets] = True
        first = np.ones(size + 3, bool)  # where parts begin
        first[1:size] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        first[second] = False
        first |= heads
        first[:size] &= kind != SPACE
        quote = np.flatnonzero(first[:size] & (lower == 39))
        if len(quote):
            after = np.concatenate([lower, np.zeros(2, np.uint8)])
            a, b = np.where(heads[quote + 1], 0, after[quote + 1]), after[quote + 2]
            one = np.isin(a, list(b"stmd"))
            two = ~heads[quote + 2] & (((a == ord("l")) & (b == ord("l"))) | (np.isin(a, list(b"rv")) & (b == ord("e"))))
            stop = np.concatenate([quote[one] + 2, quote[two] + 3])
            first[quote[one | two] + 1] = False
            stop = stop[stop < size]
            first[stop[kind[stop] != SPACE]] = True
        start = np.flatnonzero(first[:size])
        if not len(start):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint32)
        solid = kind != SPACE
        chars = lower[solid]
        bounds = np.append(np.flatnonzero(first[:size][solid]), len(chars))
        parts = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(chars)]).dictionary_encode()
        numbers = self._numbers(strings(parts.dictionary))[parts.indices.to_numpy()]
        sizes, ids = self.lists.get(numbers)
        stops = np.searchsorted(start, offsets)
        return np.diff(np.append(0, np.cumsum(sizes))[stops]), ids

    def _mixed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any texts, by their chunks."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        data, offsets = text_buffer(words.dictionary)
        odd = pa.array(self._odd(*self._block(data, offsets)))
        plain, others = words.dictionary.filter(pc.invert(odd)), strings(words.dictionary.filter(odd))
        new = [x for x in others if x not in self.known_odd]
        if len(self.known_odd) + len(new) > CACHE_WORDS:
            self.known_odd, self.odd_lists, new = {}, Pool(), others
        if new:
            self.known_odd.update(zip(new, range(self.odd_lists.n, self.odd_lists.n + len(new))))
            self.odd_lists.add(*flat([self.tokenizer.encode(x, add_special_tokens=False).ids for x in new]))
        found = Pool()
        found.add(*self._cut(*self._block(*text_buffer(plain))))
        found.add(*self.odd_lists.get(np.fromiter(map(self.known_odd.__getitem__, others), np.int64, len(others))))
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        sizes, ids = found.get(place[words.indices.to_numpy()])
        stops = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return np.diff(np.append(0, np.cumsum(sizes))[stops]), ids

    @staticmethod
    def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return *kinds_of(data[offsets[0] : offsets[-1]]), offsets - offsets[0]

    @staticmethod
    def _odd(kind: np.ndarray, lower: np.ndarray, second: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold an odd character or what may be a special token."""
        at = np.flatnonzero(kind == ODD)
        angle = np.flatnonzero(lower[:-1] == ord("<"))
        at = np.concatenate([at, angle[lower[angle + 1] == ord("|")]])
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        block = self._block(*text_buffer(texts))
        odd = self._odd(*block)
        if not odd.any():
            return lists_of(*self._cut(*block))
        plain = iter(lists_of(*self._cut(*self._block(*text_buffer(texts.filter(pa.array(~odd)))))))
        mixed = iter(lists_of(*self._mixed(texts.filter(pa.array(odd)))))
        return [next(mixed if x else plain) for x in odd]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.uint32)


def lists_of(sizes: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    bounds = np.append(0, np.cumsum(sizes)).tolist()
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, ChunkTokenizer(tokenizer_path))
        for batch in batches:
            rows: list[tuple] = []
            _, offsets = text_buffer(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in row_chunks(offsets, BLOCK_BYTES):
                for doc_id, ids in zip(doc_ids[lo:hi], tokenizer.encode(batch.column(1).slice(lo, hi - lo))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences, (lengths in order, how many), for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    groups: list[tuple[tuple[int, ...], int]] = []
    while large:  # the longest with the longest that fits beside it
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            groups.append(((a,), left.pop(a)))
            large.pop()
            continue
        b = large[k]
        take = left[a] // 2 if a == b else min(left[a], left[b])
        if not take:  # a single one of this length: its partner is shorter, if any
            if k == 0:
                groups.append(((a,), left.pop(a)))
                large.pop()
                continue
            b, take = large[k - 1], 1
        groups.append(((a, b), take))
        for n in (a, b):
            left[n] -= take
        for n in {a, b}:
            if not left[n]:
                large.remove(n)
                del left[n]
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for group in groups:
        by_gap.setdefault(capacity - sum(group[0]), []).append(group)
    gaps = sorted(by_gap)
    for n in sorted(left, reverse=True):  # what remains is short
        need = left[n]
        while need:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                full, rest = divmod(need, each)
                new = [((n,) * each, full)] * bool(full) + [((n,) * rest, 1)] * bool(rest)
                need = 0
            else:
                gap = gaps[k]
                content, many = by_gap[gap].pop()
                each = min(gap // n, -(-need // many))  # so many of this length in each sequence of the group
                fit = min(many, need // each)
                need -= fit * each
                new = [(content + (n,) * each, fit)] + [(content, many - fit)] * (many > fit)
                if not by_gap[gap]:
                    del by_gap[gap], gaps[k]
            for group in new:
                gap = capacity - sum(group[0])
                if gap not in by_gap:
                    by_gap[gap] = []
                    insort(gaps, gap)
                by_gap[gap].append(group)
    return [g for gap in sorted(by_gap) for g in by_gap[gap]]


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of equal places, ordered by rank."""
    used: Counter = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for content, many in groups:
        offset = 0
        for n in content:
            runs.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += many
            offset += n
        sequence += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in runs.items()}


def ranked(parts: DataFrame, n_buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length, without gathering a length in one task."""
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n_buckets)))
    sizes = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return parts.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "bucket"]).select(*[c for c in parts.columns if c != "bucket"], (F.col("before") + F.col("inside")).alias("rank"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, bucket_rows: int = 20_000) -> DataFrame:
    """Every piece with its sequence and its offset there.

    bucket_rows: rows of one length are ranked in buckets of about so many rows of the whole table.
    """
    parts = stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = places(plan_lengths(counts, capacity))
    total = sum(counts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, seq, off = plan[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], "right") - 1
                sequence[part] = seq[k] + rank[part] - first[k]
                offset[part] = off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked(parts, max(8, total // bucket_rows)).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, offset long")
