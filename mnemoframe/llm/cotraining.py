"""Quality classifier by co-training of two views.

View one sees the text (surface measures, and its words in hash classes), view two the page metadata (language, source, stated
length). Both begin with labelled rows of the ids that may be learned from; in every
round each labels the pool's rows on which it is most confident and hands them to the other as training rows. The views are then
calibrated (Platt) on labelled rows that neither has seen, and a logistic regression on the two calibrated logits combines them.

Fitted on bounded samples: at most ``labelled_rows`` labelled and ``pool_rows`` other rows (those of least hash of doc_id); every
document is scored on its whole text.

Defined cases: null or empty texts have zero text features; null metadata is a value of its own; without labels of both classes
every score is the share of good ones (0.5 without labels). Repeated rows get equal scores; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.learners import Logistic, sigmoid

SURFACE = 13
WORD_CLASSES = 128
N_TEXT = SURFACE + WORD_CLASSES
SOURCES = 16
SCHEMA = "doc_id long, held_out boolean, text_score double, meta_score double, score double, kept boolean"


@lru_cache(1 << 16)
def word_class(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_CLASSES


def text_features(text: str) -> np.ndarray:
    """Surface measures, then the root of each word class's share of the words."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return np.zeros(N_TEXT)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    distinct = len(counts)
    same = sum(map(str.__eq__, words, words[1:]))
    letters = sum(map(str.isalpha, words))
    symbols = sum(map(text.count, "#*$%&|<>{}\\^~="))
    upper = sum(map(str.isupper, words))
    digits = sum(map(text.count, "0123456789"))
    surface = [
        np.log(n), chars / n, distinct / n ** 0.8, same / n, letters / n, 100 * symbols / chars, upper / n, 100 * digits / chars, 100 * text.count("!") / chars,
        1 - len(set(lines)) / len(lines), np.log(n / len(lines)), max(counts.values()) / n, 100 * (text.count(".") + text.count(",")) / chars,
    ]
    classes = np.bincount(list(map(word_class, counts)), weights=list(counts.values()), minlength=WORD_CLASSES)
    return np.concatenate([surface, np.sqrt(classes / n)])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Length, one-hot language and source; names beyond any fixed list share hash classes."""
    out = [0.0] * (2 + 8 + SOURCES)
    out[0], out[1] = np.log1p(max(0, n_chars or 0)), float(n_chars is None)
    out[2 + zlib.crc32((lang or "?").encode()) % 8] = 1.0
    out[10 + zlib.crc32((source or "?").encode()) % SOURCES] = 1.0
    return out


class Model:
    def __init__(self, text: Logistic | None, meta: Logistic | None, platt: list[Logistic], both: Logistic | None, share: float):
        self.text, self.meta, self.platt, self.both, self.share = text, meta, platt, both, share

    def __call__(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return (np.full(len(x), self.share),) * 3
        logits = [p.margin(v.margin(a)[:, None]) for p, v, a in zip(self.platt, (self.text, self.meta), (x, z))]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(self.both.margin(np.column_stack(logits)))


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_z: np.ndarray, rounds: int = 5, each: int = 200, confident: float = 0.95) -> tuple[Logistic, Logistic]:
    """The two views after ``rounds`` rounds, in each of which each view hands at most ``each`` rows to the other."""
    given: list[dict[int, float]] = [{}, {}]  # pool rows that each view learns from, with the other's labels

    def trained(k: int) -> Logistic:
        own, pool = ((x, pool_x), (z, pool_z))[k]
        rows = list(given[k])
        weight = np.concatenate([np.ones(len(y)), np.full(len(rows), 0.5)])
        return Logistic(np.vstack([own, pool[rows]]), np.concatenate([y, [given[k][r] for r in rows]]), weight)

    views = [trained(0), trained(1)]
    for _ in range(rounds):
        for k, pool in enumerate((pool_x, pool_z)):
            if not len(pool):
                continue
            p = sigmoid(views[k].margin(pool))
            sure = np.maximum(p, 1 - p)
            fresh = [r for r in np.argsort(-sure, kind="stable") if sure[r] >= confident and r not in given[1 - k]][:each]
            given[1 - k].update((r, float(p[r] > 0.5)) for r in fresh)
        views = [trained(0), trained(1)]
    return views[0], views[1]


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([text_features(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, N_TEXT)
    z = np.array([meta_features(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))], float).reshape(-1, 10 + SOURCES)
    return x, z


def fit(docs: DataFrame, labels: DataFrame, train: str = "true", labelled_rows: int = 8_000, pool_rows: int = 4_000) -> Model:
    """Learns from the ids for which ``train`` holds alone; rows of other ids are neither labelled rows nor in the pool."""
    rank = F.xxhash64(F.col("doc_id"), F.lit(29))
    known = labels.where(train).where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    picked = known.orderBy(rank, "doc_id", "label").limit(labelled_rows)
    # rows without a label, those of least hash: one more than the labelled can take away
    pool = docs.select("doc_id").where(train).where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti").orderBy(rank, "doc_id").limit(pool_rows).select("doc_id", F.lit(None).cast("double").alias("label"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns).join(F.broadcast(picked.unionAll(pool)), "doc_id").select(*columns, "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, z = _measured(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(z), pa.list_(pa.float64()))], names=["doc_id", "label", "x", "z"])

    got = rows.mapInArrow(measure, "doc_id long, label double, x array<double>, z array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")  # numbers of a bounded sample
    y = got["label"].to_numpy(float)
    has = ~np.isnan(y)
    if len(set(y[has] > 0.5)) < 2:
        return Model(None, None, [], None, float(y[has].mean()) if has.any() else 0.5)
    x, z = np.array(got["x"].tolist()), np.array(got["z"].tolist())
    lx, lz, ly = x[has], z[has], (y[has] > 0.5).astype(float)
    held = np.arange(len(ly)) % 4 == 0
    if len(set(ly[held])) < 2 or len(set(ly[~held])) < 2:
        held = np.ones(len(ly), bool)
    train = ~held if (~held).any() else held
    text, meta = co_train(lx[train], lz[train], ly[train], x[~has], z[~has])
    platt = [Logistic(v.margin(a[held])[:, None], ly[held]) for v, a in ((text, lx), (meta, lz))]
    logits = np.column_stack([p.margin(v.margin(a[held])[:, None]) for p, v, a in zip(platt, (text, meta), (lx, lz))])
    return Model(text, meta, platt, Logistic(logits, ly[held]), float(ly.mean()))


def classify(docs: DataFrame, labels: DataFrame, train: str = "true", held_out: str = "false", threshold: float = 0.5, labelled_rows: int = 8_000, pool_rows: int = 4_000) -> DataFrame:
    """One row per document: held_out, the views' calibrated scores, the combined score, kept (score of ``threshold`` or more)."""
    model = fit(docs, labels, train, labelled_rows, pool_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m, s = model(*_measured(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "held_out", "text_score", "meta_score", "score", "kept"])

    return docs.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text", "lang", "source", "n_chars").mapInArrow(run, SCHEMA)
