"""Signals of messages and replies, and replays of small state machines over ordered lists: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions import chunks
from mnemoframe.functions import text as T


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reply_quality(reply: Column, delay_ms: Column, previous: Column, topic: Column) -> Column:
    """How satisfied a reply sounds, 0 to 1: length, delay, questions, closing words, switched topic."""
    n, delay = F.length(reply), delay_ms / 1000
    score = 0.5 + F.when(n > 50, 0.12).when(n > 15, 0.05).when(n < 5, -0.1).otherwise(0.0)
    score = score + F.when(delay < 5, 0.1).when(delay > 120, -0.15).otherwise(0.0)
    score = score + F.when(reply.rlike("[？?]|怎么|为什么|能不能|具体|详细"), 0.12).otherwise(0.0)
    score = score - F.when(chunks.trimmed(reply).rlike(r"(?i)^(嗯|好的?|ok|谢谢|收到|明白|了解)\s*[。.!！]?\s*$"), 0.05).otherwise(0.0)
    return clamp(score - F.when((previous != "") & (topic != "") & (previous != topic), 0.08).otherwise(0.0), 0.0, 1.0)


def signal_of(quality: Column) -> Column:
    return F.when(quality > 0.6, "positive").when(quality < 0.35, "negative").otherwise("neutral")


# Phrases of reasons, arrows, and the confidence of each form; the last column is cheap and true wherever the form can match.
REASONS = [(r"因为(.{3,80})所以(.{3,120})", 0.7, "因为"), (r"(?i)(?:based on|because)\s+(.{3,80})(?:therefore|so|thus)\s+(.{3,120})", 0.7, "(?i)based on|because"), (r"(.{3,80})\s*[=\-]>\s*(.{3,120})", 0.6, "[=-]>")]


def reasoning(text: Column) -> Column:
    """struct(context, conclusion, confidence) of the first form that the text holds, else null."""
    forms = [F.when(text.rlike(hint) & text.rlike(p), F.struct(chunks.trimmed(F.regexp_extract(text, p, 1)).alias("context"), chunks.trimmed(F.regexp_extract(text, p, 2)).alias("conclusion"), F.lit(c).alias("confidence"))) for p, c, hint in REASONS]
    return F.coalesce(*forms)


# First weights of the answer-quality features.
QUALITY_BIAS = -0.225
QUALITY_WEIGHTS = {"medium": 0.5, "long": 0.5, "too_long": -1.0, "too_short": -1.5, "reasoned": 1.0, "code": 0.5, "listed": 0.3, "unsure": 0.3, "refusal": -1.5, "relevance": 1.5, "exposed": -2.0, "gain": 0.5}


def answer_features(question: Column, answer: Column) -> dict[str, Column]:
    """Features that one question and its answer give; those of earlier and later messages are the caller's."""
    q, a = F.array_distinct(chunks.words(question)), chunks.words(answer)
    shared, n_q = F.size(F.filter(a, lambda w: F.array_contains(q, w))), F.size(q)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "medium": flag(F.length(answer) > 50), "long": flag(F.length(answer) > 200), "too_long": flag((F.length(answer) > 1000) & (F.length(question) < 30)), "too_short": flag((F.length(answer) < 10) & (F.length(question) > 50)),
        "reasoned": flag(answer.rlike("因为|所以|首先|其次|原因|本质上|because|therefore")), "code": flag(F.contains(answer, F.lit("```"))), "listed": flag(answer.rlike(r"(?m)^[-*•]\s|^\d+\.\s")),
        "unsure": flag(answer.rlike("不确定|不太确定|可能|I'm not sure")), "refusal": flag(answer.rlike("我不知道|无法回答|超出了我的")), "exposed": flag(answer.rlike("(?i)作为一个?AI|作为人工智能|作为语言模型|I am an AI")),
        "relevance": F.when(n_q > 0, F.least(F.lit(1.0), shared / n_q)).otherwise(0.0), "gain": flag((n_q > 0) & ((F.size(a) - shared) > 2 * n_q)),
    }


def answer_score(question: Column, answer: Column) -> Column:
    """1 to 10 by a logistic of the features."""
    features = answer_features(question, answer)
    logit = reduce(lambda x, k: x + QUALITY_WEIGHTS[k] * features[k], QUALITY_WEIGHTS, F.lit(QUALITY_BIAS))
    return F.round(9 / (1 + F.exp(-logit)) + 1, 1)


def circadian_energy(hour: Column, peak: float = 10.0) -> Column:
    """Energy modifier of an hour of day: a daily and a half-daily wave, less a penalty before five."""
    wave = 0.7 * F.cos((hour - peak) / 24 * 2 * F.pi()) + 0.3 * F.cos((hour - peak) / 12 * 2 * F.pi())
    return 0.2 * wave - 0.05 - F.when(hour < 5, 0.15 * (1 - F.abs(hour - 2.5) / 2.5)).otherwise(0.0)


# Words of strain and of relief.
STRAIN = "烦|累|崩|急|压力|焦虑|受不了|算了|不想|头疼|烦死|frustrated|stressed|overwhelmed|exhausted|annoyed|ugh|burnout"
RELIEF = "谢|好的|明白|解决|搞定|不错|太好|thanks|got it|solved|fixed|great|awesome|nice"


def stress_signal(message: Column, gap_ms: Column) -> Column:
    s = F.when(F.length(message) < 10, 0.15).when(F.length(message) > 80, -0.1).otherwise(0.0)
    s = s + F.when(message.rlike(STRAIN), 0.25).otherwise(0.0) - F.when(message.rlike(RELIEF), 0.15).otherwise(0.0)
    return clamp(s + F.when(message.rlike("[！!]{2,}|[？?]{2,}"), 0.1).otherwise(0.0) + F.when(gap_ms < 10000, 0.1).otherwise(0.0), -0.3, 0.5)


def stress_replay(signals: Column, k: float = 0.15, damping: float = 0.3) -> Column:
    """struct(x, v) of a damped spring driven by the signals in order."""

    def step(acc: Column, f: Column) -> Column:
        v = acc["v"] + (-k * acc["x"] + f - damping * acc["v"])
        return F.struct(clamp(acc["x"] + v, 0.0, 1.0).alias("x"), clamp(v, -0.5, 0.5).alias("v"))

    return F.aggregate(signals, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("v")), step)


def stress_phase(x: Column, v: Column) -> Column:
    return F.when((x > 0.6) & (v > 0), "peak").when((x > 0.3) & (v > 0.05), "accumulating").when((x > 0.3) & (v < -0.05), "releasing").otherwise("calm")


def belief(reinforced: Column, prior: float = 0.5) -> Column:
    """Confidence after a list of reinforcements (true) and contradictions (false) in order."""
    return F.aggregate(reinforced, F.lit(prior), lambda p, yes: F.when(yes, p + (1 - p) * 0.2).otherwise(p * 0.6))


def relationship(events: Column) -> Column:
    """struct(trust, familiarity) after corrections, positive turns and session ends in order, from 0.5 and 0."""

    def step(acc: Column, e: Column) -> Column:
        trust = F.when(e == "correction", F.greatest(F.lit(0.0), acc["trust"] - 0.03)).when(e == "positive", F.least(F.lit(1.0), acc["trust"] + 0.02)).otherwise(acc["trust"])
        known = F.when(e == "positive", F.least(F.lit(1.0), acc["familiarity"] + 0.01)).when(e == "session_end", F.least(F.lit(1.0), acc["familiarity"] + 0.005)).otherwise(acc["familiarity"])
        return F.struct(trust.alias("trust"), known.alias("familiarity"))

    return F.aggregate(events, F.struct(F.lit(0.5).alias("trust"), F.lit(0.0).alias("familiarity")), step)


# Words of agreement, of dissent and of a shrug.
AGREEMENT = "谢|感谢|棒|好的|对|没错|exactly|thanks|great|yes|right|correct"
DISSENT = "不对|错了|不是|wrong|no|incorrect"
SHRUG = "嗯|哦|ok|mm|hm"


def engagement(reply: Column, response: Column) -> Column:
    """How engaged a reply to a response is, 0 to 1; an empty reply gives 0."""
    ratio = F.length(reply) / F.greatest(F.lit(1), F.length(response))
    score = 0.5 + F.when(ratio > 1, 0.25).when(ratio > 0.5, 0.15).otherwise(0.0) + F.when(reply.rlike("[？?]"), 0.1).otherwise(0.0)
    score = score + F.when(reply.rlike(f"(?i){AGREEMENT}"), 0.15).otherwise(0.0) - F.when(reply.rlike(f"(?i){DISSENT}"), 0.2).otherwise(0.0)
    return F.when(reply == "", 0.0).otherwise(clamp(score - F.when((F.length(reply) < 5) & reply.rlike(f"(?i){SHRUG}"), 0.15).otherwise(0.0), 0.0, 1.0))


def affinity(memory: Column, response: Column) -> Column:
    """How much of a memory a response took up: trigrams, tokens, and runs of two to four CJK characters."""
    m, r = F.lower(memory), F.lower(response)
    kept = lambda t: F.filter(T.tokens(t), lambda w: F.length(w) >= 2)
    shared = chunks.bound(kept(m), lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, kept(r))) / F.size(w)).otherwise(F.lit(0.0)))
    names = F.regexp_extract_all(m, F.lit("([一-鿿]{2,4})"), F.lit(1))
    named = F.when(F.size(names) > 0, F.size(F.filter(names, lambda n: F.contains(r, n))) / F.size(names)).otherwise(F.lit(0.0))
    alike = chunks.bound(T.trigrams(m), lambda a: chunks.bound(T.trigrams(r), lambda b: T.jaccard(a, b)))
    return 0.3 * alike + 0.4 * shared + 0.3 * named


def affinity_signal(value: Column) -> Column:
    return F.when(value > 0.15, "used").when(value > 0.05, "partial").otherwise("unused")
