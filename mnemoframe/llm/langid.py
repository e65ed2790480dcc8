"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over sampled labelled text. A text is parsed with it into phrases: each phrase is
the longest match with the labelled text that begins where the last phrase ended. Phrases per character estimate the cross
entropy; the language that needs fewest wins. Many segments are parsed in lockstep, one table lookup per character.

Characters are lower-cased letters; everything else is a space, runs of spaces are one. Texts are parsed whole: segments of
``segment`` characters are parsed side by side and then joined exactly, so where a text is cut changes nothing.

Defined cases: null texts and texts without a letter get ``und`` and score 0; a language is learned only if a training row holds
it; without any training row every text gets ``und``; ties go to the language first in alphabetical order. Repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, phrases double"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For every code point: its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    code = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code != 0
    keep[1:] |= code[:-1] != 0  # of a run of others the first stays, as the space
    return code[keep]


class Automaton:
    """Suffix automaton as a table: state, symbol -> state, 0 where no match goes on. The root is state 1."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        link, length, step = [0, 0], [-1, 0], [{}, {}]
        last = 1
        for c in symbols.tolist():
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.table = np.zeros((len(step), n_symbols), np.int32)
        for state, out in enumerate(step):
            for c, to in out.items():
                self.table[state, c] = to
        self.flat = self.table.ravel()
        self.width = n_symbols

    def steps(self, grid: np.ndarray, sizes: np.ndarray, start: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(finished, state): phrases that end at each position of each column of ``grid``, and the state after its last symbol.

        grid: positions x segments, of which the first ``sizes`` symbols count; columns come ordered by falling size. start: state
        before the first symbol. known: what an earlier parse of the columns from the root finished; where both begin a phrase at
        the same place they agree from there on, so the column's parse ends there and its state is -1.
        """
        n = grid.shape[1]
        state = start.astype(np.int32)
        out = np.zeros(grid.shape, np.uint8) if known is None else known
        at = np.arange(n)
        root = self.table[1]
        for k in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(-sizes[at], -k, "left")) if known is not None or k >= sizes[-1] else n
            if not m:
                break
            live = at[:m]
            c = grid[k, live] if known is not None else grid[k, :m]
            before = state[live]
            s = self.flat[before * self.width + c]
            stop = s == 0
            here = np.zeros(m, np.uint8)
            if stop.any():
                s = np.where(stop, root[c], s)
                lost = s == 0
                here = (stop & (before != 1)).astype(np.uint8) + lost  # a symbol that the labelled text lacks is a phrase of its own
                s[lost] = 1
            state[live] = s
            if known is None:
                out[k, :m] = here
            else:
                met = stop & (known[k, live] > 0)
                out[k, live] = here
                if met.any():
                    state[live[met]] = -1
                    at = np.concatenate([live[~met], at[m:]])
        return out, state

    def phrases(self, grid: np.ndarray, sizes: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
        """Number of phrases that end in each column; follows: the column of the segment before in the same text, -1 for none.

        Segments are first parsed each from the root. Then each goes on from the state in which the one before ended, until it
        begins a phrase where its own parse did; this is repeated for those whose predecessor ended otherwise than thought.
        """
        n = grid.shape[1]
        finished, state = self.steps(grid, sizes, np.ones(n))
        follows = np.full(n, -1) if follows is None else follows
        after = np.full(n, -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        todo = np.flatnonzero(follows >= 0)
        while len(todo):
            entered = state[follows[todo]]
            again, end = self.steps(grid[:, todo], sizes[todo], entered, finished[:, todo])
            finished[:, todo] = again
            moved = (end >= 0) & (end != state[todo])
            state[todo[moved]] = end[moved]
            todo = np.sort(after[todo[moved]])
            todo = todo[todo >= 0]
        last = after < 0  # a phrase still under way ends with the text
        return finished.sum(axis=0, dtype=np.int64) + (last & (state != 1))


class Parser:
    def __init__(self, samples: dict[str, str], segment: int = 512):
        self.langs = sorted(samples)
        self.segment = segment
        texts = [letters(samples[x]) for x in self.langs]
        alphabet = np.unique(np.concatenate([*texts, np.zeros(1, np.int32)]))
        self.symbol = np.full(0x110000, len(alphabet), np.uint16)  # one more for letters never seen
        self.symbol[alphabet] = np.arange(len(alphabet))
        self.automata = [Automaton(self.symbol[t], len(alphabet) + 1) for t in texts]

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases per character, texts x languages; nan where a text has no letter."""
        parts, owner, first = [], [], []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            s = letters(text)
            if not s.any():
                continue
            sizes[k] = len(s)
            s = self.symbol[s]
            cut = range(0, len(s), self.segment)
            parts += [s[a : a + self.segment] for a in cut]
            owner += [k] * len(cut)
            first += [True] + [False] * (len(cut) - 1)
        out = np.full((len(texts), len(self.langs)), np.nan)
        if not parts:
            return out
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((self.segment, len(parts)), np.uint16)
        for column, k in enumerate(order):
            grid[: size[k], column] = parts[k]
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        follows = np.where(first, -1, np.append(-1, place[:-1]))[order]
        owner = np.array(owner)[order]
        found = sizes > 0
        for j, automaton in enumerate(self.automata):
            total = np.bincount(owner, weights=automaton.phrases(grid, size[order], follows), minlength=len(texts))
            out[found, j] = total[found] / sizes[found]
        return out


_PARSERS: dict[int, Parser] = {}


def training_sample(docs: DataFrame, train: str, docs_per_lang: int = 64, chars_per_doc: int = 4096, chars_per_lang: int = 24_000) -> dict[str, str]:
    """Labelled text of each language: about ``chars_per_lang`` characters, evenly from at most ``docs_per_lang`` documents.

    The documents are those of least hash in each of ``docs_per_lang`` hash classes, and the piece that each lends begins where its
    hash says, so the choice depends on no order; one pre-aggregated row per language and class reaches the driver.
    """
    rank = F.xxhash64("doc_id", "text")
    begins = (1 + F.pmod(F.xxhash64("text", F.lit(3)), F.greatest(F.lit(1), F.length("text") - chars_per_doc + 1))).cast("int")
    rows = docs.where("lang is not null and text is not null").where(train)
    best = rows.groupBy("lang", F.pmod(rank, F.lit(docs_per_lang)).alias("class")).agg(F.min_by(F.substring(F.col("text"), begins, F.lit(chars_per_doc)), F.struct(rank, "doc_id")).alias("text"))
    held: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "class").toLocalIterator():
        held.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(evenly(texts, chars_per_lang)) for lang, texts in held.items()}


def evenly(texts: list[str], most: int) -> list[str]:
    """The texts cut so that together they have at most ``most`` characters; what short ones leave goes to the longer."""
    out = dict.fromkeys(range(len(texts)), "")
    for left, k in zip(range(len(texts), 0, -1), sorted(out, key=lambda k: (len(texts[k]), k))):
        out[k] = texts[k][: most // left]
        most -= len(out[k])
    return [out[k] for k in range(len(texts))]


class Judge:
    """Winner, score and phrases per character for batches of texts; parsers are built once in each worker."""

    def __init__(self, samples: dict[str, str], segment: int):
        self.samples, self.segment = samples, segment
        self.key = hash((tuple(sorted(samples.items())), segment))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.samples:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        parser = _PARSERS.get(self.key)
        if parser is None:
            _PARSERS.clear()
            parser = _PARSERS[self.key] = Parser(self.samples, self.segment)
        langs, scores, best = [], [], []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= 2_000_000):
                chars += len(texts[hi] or "")
                hi += 1
            rates = parser.rates([t or "" for t in texts[lo:hi]])
            known = ~np.isnan(rates[:, 0])
            rates[~known] = 1
            two = np.sort(rates, axis=1)[:, :2]
            score = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1] + two[:, 0], 1e-9) if rates.shape[1] > 1 else 1 - rates[:, 0]
            langs += [parser.langs[b] if k else "und" for b, k in zip(rates.argmin(axis=1), known)]
            scores.append(np.where(known, np.clip(score, 0, 1), 0.0))
            best.append(two[:, 0])
            lo = hi
        none = [np.zeros(0)]
        return langs, np.concatenate(scores or none), np.concatenate(best or none)


def identify(docs: DataFrame, train: str = "true", held_out: str = "false", segment: int = 512, **sample: int) -> DataFrame:
    """One row per document: lang_pred, score and phrases per character of the winner.

    train, held_out: SQL conditions over ``documents``. score: (second - best) / (second + best) of the two best languages' phrases;
    one learned language gives 1 - phrases per character.
    """
    judge = Judge(training_sample(docs, train, **sample), segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, best = judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(best)], names=["doc_id", "held_out", "lang_pred", "score", "phrases"])

    return docs.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def recognised(docs: DataFrame, train: str = "true", most_phrases: float = 0.45, segment: int = 512, **sample: int) -> DataFrame:
    """The documents in a learned language: not ``und``, and at most ``most_phrases`` phrases per character."""
    judge = Judge(training_sample(docs, train, **sample), segment)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, best = judge(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" for x in langs], pa.bool_()) if not len(best) else pa.array((np.array(langs) != "und") & (best <= most_phrases)))

    return docs.mapInArrow(run, docs.schema)
