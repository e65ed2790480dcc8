"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, how often their words stand near a second-person word, capitals,
punctuation, and rates of obfuscated words. The learned lexicon holds the words with the largest log-odds between toxic and other
training rows, and these odds are summed over a text's distinct words. Lexicon, trees and calibration are fitted on at most
``sample_rows`` training rows (those of least hash of doc_id); every whole text is scored.

Defined cases: null and empty texts have zero features and get a score like any other; labels that are null are no training rows;
without two classes among the training rows every score is the share of toxic ones, or 0. Repeated documents get equal scores;
repeated labels count as often as they occur; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import stored
from mnemoframe.llm.learners import Boosted, Isotonic

# Common English insults and words of contempt.
LEXICON = frozenset(
    "idiot idiots stupid moron morons loser losers pathetic scum worthless trash garbage clown disgusting dumb dumbass fool fools jerk "
    "imbecile cretin degenerate vermin filth filthy freak creep ugly hate hateful kill die shut suck sucks crap damn hell bastard bitch "
    "asshole ass shit bullshit fuck fucking fucked slut whore retard retarded pig pigs rat rats parasite subhuman lowlife coward".split()
)
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours youre yourself u ur tu te toi ton vous votre vos du dich dir dein deine euch euer tú ti usted ustedes vosotros".split())
PLAIN = str.maketrans("01345@$7", "oleasast")  # fixed values: usual substitutes
WORD = re.compile(r"[^\W_]+(?:[*@$#!'’+][^\W_]+)*")
HIDDEN = re.compile(r"[a-z]+[*@$#!+0-9]+[a-z]+")
N_FEATURES = 15
NEAR = 6
PARTS = 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def plain(word: str) -> str:
    """A word with usual substitutes for letters undone and separators dropped."""
    return re.sub(r"[^a-z]", "", word.translate(PLAIN))


def features(text: str, learned: dict[str, float]) -> list[float]:
    words = WORD.findall(text)
    low = text.lower()
    low_words = WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    fixed = [k for k, w in enumerate(low_words) if w in LEXICON]
    own = [k for k, w in enumerate(low_words) if w in learned]
    hidden = [w for w in set(low_words) if not w.isalpha() and HIDDEN.fullmatch(w)]
    unmasked = sum(plain(w) in LEXICON or plain(w) in learned for w in hidden)
    odds = [learned[w] for w in {low_words[k] for k in own}]
    hits = sorted({*fixed, *own})
    you = np.array([k for k, w in enumerate(low_words) if w in SECOND_PERSON], np.int64)
    near = 0
    if hits and len(you):
        at = np.array(hits)
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)]))
        near = int((gap <= NEAR).sum())
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    return [
        np.log1p(n), 100 * len(fixed) / n, np.log1p(len(fixed)), 100 * len(own) / n, sum(odds), max(odds, default=0.0), float(len({low_words[k] for k in hits})),
        near / max(1, len(hits)), np.log1p(near), capitals / n, 100 * text.count("!") / chars, 100 * text.count("?") / chars,
        100 * (text.count("*") + text.count("#") + text.count("$")) / chars, 100 * len(hidden) / n, float(unmasked),
    ]


def feature_matrix(texts: list[str | None], learned: dict[str, float]) -> np.ndarray:
    return np.array([features(t or "", learned) for t in texts], float).reshape(-1, N_FEATURES)


class Model:
    def __init__(self, learned: dict[str, float], margin: Boosted | None, calibration: Isotonic | None, share: float):
        self.learned, self.margin, self.calibration, self.share = learned, margin, calibration, share

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.margin is None:
            return np.full(len(texts), self.share)
        return np.clip(self.calibration(self.margin.margin(feature_matrix(texts, self.learned))), 0, 1)


def sampled(docs: DataFrame, labels: DataFrame, label: str, train: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, label, part) of at most ``sample_rows`` labelled training rows; part is a hash class."""
    rank = F.xxhash64(F.col("doc_id"), F.lit(17))
    ids = labels.where(train).where(f"doc_id is not null and {label} is not null").select("doc_id", F.col(label).cast("double").alias("label")).orderBy(rank, "doc_id", "label").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(PARTS)))


def learned_lexicons(rows: DataFrame, least_rows: int = 4, least_log_odds: float = 2.5, most: int = 400, most_words: int = 20_000) -> list[dict[str, float]]:
    """For each part the lexicon of the other parts' rows, and at the end that of all rows.

    A lexicon has at most ``most`` words with their smoothed log-odds, of those in ``least_rows`` toxic rows and 0.3 % of them or
    more; only the ``most_words`` words in the most toxic rows of the sample are looked at.
    """
    totals = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    words = rows.select("label", "part", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,24})"), F.lit(1)))).alias("word"))
    sums = [F.sum(F.when(F.col("part") == k, v).otherwise(0)).alias(f"{name}{k}") for k in range(PARTS) for name, v in (("t", F.col("label")), ("c", 1 - F.col("label")))]
    counts = words.groupBy("word").agg(F.sum("label").alias("t"), *sums).where(F.col("t") >= least_rows).orderBy(F.desc("t"), "word").limit(most_words).collect()
    out = []
    for left_out in [*range(PARTS), None]:
        parts = [k for k in range(PARTS) if k != left_out]
        toxic, other = (sum(totals.get((k, y), 0) for k in parts) for y in (1.0, 0.0))
        found = []
        for r in counts:
            t, c = sum(r[f"t{k}"] for k in parts), sum(r[f"c{k}"] for k in parts)
            odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (other + 1))
            if t >= max(least_rows, 0.003 * toxic) and odds >= least_log_odds:
                found.append((-float(odds), -t, r["word"]))
        out.append({word: -odds for odds, _, word in sorted(found)[:most]})
    return out


def fit(docs: DataFrame, labels: DataFrame, train: str, sample_rows: int = 12_000) -> Model:
    """Every training row is measured with the lexicon of the other parts, and calibration takes the margins of trees that haven't
    seen the row's part, so neither is fitted on what it is judged by."""
    rows = stored(sampled(docs, labels, "toxic", train, sample_rows), "labelled")  # read three times below
    lexicons = learned_lexicons(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "", lexicons[p]) for t, p in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "part", "x"])

    got = rows.mapInArrow(measure, "doc_id long, label double, part long, x array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")  # numbers of a bounded sample
    y = (got["label"].to_numpy() > 0.5).astype(float)
    if len(set(y)) < 2:
        return Model({}, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].tolist())
    part = got["part"].to_numpy()
    margin = Boosted(x, y)
    unseen = margin.margin(x)
    for k in range(PARTS):
        if len(set(y[part != k])) == 2 and (part == k).any():
            unseen[part == k] = Boosted(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicons[-1], margin, Isotonic(unseen, y), float(y.mean()))


def score(docs: DataFrame, labels: DataFrame, train: str, held_out: str, threshold: float = 0.7, sample_rows: int = 12_000) -> DataFrame:
    """One row per document: held_out, score and predicted."""
    model = fit(docs, labels, train, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)
