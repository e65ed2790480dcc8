"""What a text says of itself: its emotion, reasons, dates, code symbols, stack frames and style. Column -> Column, evaluated in the JVM.

A null text gives null, or the result of no match where a rule chain ends in one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions import signals as G
from mnemoframe.functions.chunks import bound, trimmed

# The rules of emotion labels in their order (label, confidence, words in the lower-case text or a pattern).
LOUD = "[！!]{2,}"
EMOTION_RULES = [
    ("anger", 0.9, ["气死", "生气", "怒了", "操", "妈的", "什么玩意", "脑残", "智障", "angry", "furious", "pissed", "hate"]),
    ("anxiety", 0.85, ["焦虑", "担心", "紧张", "害怕", "慌", "着急", "来不及", "怎么办", "完蛋", "压力大", "压力好大", "撑不住", "被裁", "要被裁", "worried", "nervous", "scared", "anxious", "panic", "deadline"]),
    ("anxiety", 0.8, "deadline|ddl|来不及|赶不上"),
    ("frustration", 0.85, ["烦死", "受不了", "无语", "服了", "废了", "头疼", "搞不定", "又出问题", "又挂了", "又崩了", "不适合", "放弃了", "没救了", "stuck", "broken", "failed", "give up", "hopeless"]),
    ("frustration", 0.7, "又.*了|还是不行|试了.*[次遍]|改了.*天|搞了.*还|都不行|还是不对"),
    ("frustration", 0.65, "是不是不适合"),
    ("disappointment", 0.8, ["失望", "白费", "白忙", "没想到", "原来是这样", "早知道", "disappointed", "wasted", "regret"]),
    ("sadness", 0.85, ["难过", "伤心", "心疼", "想哭", "哭了", "好难", "太难了", "心累", "无力", "分手", "离职", "住院", "去世", "走了", "sad", "heartbroken", "crying", "lonely", "miss", "breakup", "quit", "hospitalized", "died"]),
    ("confusion", 0.8, ["困惑", "不明白", "搞不懂", "什么意思", "为什么会", "怎么回事", "看不懂", "迷茫", "怎么理解", "帮我解释", "到底怎么", "confused", "don't understand", "what do you mean", "lost", "how"]),
    ("confusion", 0.6, "[？?]{2,}"),
    ("relief", 0.8, ["终于", "搞定了", "解决了", "原来如此", "恍然大悟", "明白了", "通了", "总算", "不容易", "finally", "solved", "fixed", "got it", "aha"]),
    ("pride", 0.75, ["搞定", "成功", "做到了", "完成了", "上线了", "过了", "拿到了", "通过了", "夸了我", "star", "did it", "success", "deployed", "passed", "promoted"]),
    ("anticipation", 0.7, ["期待", "好想", "等不及", "希望", "打算", "准备", "要开始", "excited", "looking forward", "can't wait", "hope", "planning"]),
    ("gratitude", 0.85, ["感谢", "谢谢", "多亏", "幸好", "还好有你", "帮了大忙", "grateful", "thank you", "thanks to", "appreciate"]),
    ("joy", 0.8, ["开心", "哈哈", "太棒", "牛逼", "厉害", "完美", "爽", "舒服", "赞", "嘿嘿", "心情好", "心情超好", "高兴", "太好了", "好开心", "happy", "great", "awesome", "amazing", "perfect", "love it", "so good"]),
    ("joy", 0.7, "[哈嘻]{3,}"),
    ("joy", 0.4, G.POSITIVE),
    ("frustration", 0.4, G.NEGATIVE),
]
# Pleasure, arousal, dominance, certainty and novelty of each label.
PADCN = {
    "joy": (0.6, 0.4, 0.2, 0.3, 0.1), "gratitude": (0.5, 0.1, -0.1, 0.3, 0.0), "pride": (0.5, 0.3, 0.5, 0.4, 0.1), "anticipation": (0.3, 0.5, 0.1, -0.2, 0.5), "relief": (0.4, -0.3, 0.2, 0.5, -0.1), "anxiety": (-0.5, 0.6, -0.4, -0.6, 0.2),
    "frustration": (-0.5, 0.4, -0.2, -0.1, -0.2), "anger": (-0.7, 0.8, 0.3, 0.2, -0.1), "sadness": (-0.6, -0.4, -0.5, -0.2, -0.3), "disappointment": (-0.5, -0.2, -0.3, -0.3, -0.2), "confusion": (-0.1, 0.2, -0.4, -0.7, 0.3),
}
AXES = ["pleasure", "arousal", "dominance", "certainty", "novelty"]
# Patterns of reasons, of relative dates (days from the row's own date, or a constant), of code and of stack traces.
REASON = r"(?i)(?:because|因为|由于|是因为|之所以.*?是|所以选.*?是因为)\s*[,，:：]?\s*(.{4,80}?)(?:[。.!！;；]|\z)"
DATES = [("(?i)昨天|yesterday", -1), ("前天", -2), ("(?i)今天|today", 0), ("(?i)明天|tomorrow", 1), ("(?i)上周|last week", "7天前"), ("(?i)上个月|last month", "30天前")]
BACKTICKED = r"`([a-zA-Z_]\w{2,})`"
IDENTIFIER = r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z]\w*_\w+)\b"
NO_SYMBOLS = ["forEach", "indexOf", "toString", "valueOf", "hasOwnProperty", "console_log"]
ERROR_LINE = r"(?i)(?:Error|错误|error|FAIL|panic|Exception|TypeError|ReferenceError|SyntaxError)[:：]\s*(.{10,120})"
AT_LINE = r"^\s*at\s+.+[:(]\d+"
TRACEBACK = r"Traceback\s*\(most recent call last\)"
AT_FRAME = r"\(([^)]+:\d+:\d+)\)"
FILE_FRAME = r'File\s+"([^"]+)",\s*line\s+(\d+)'


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def emoji_mood(message: Column) -> Column:
    """Mean mood of the known emoji that occur, null without one."""
    here = [F.when(F.contains(message, F.lit(e)), F.lit(float(m))) for e, m in G.EMOJI_MOOD.items()]
    found = F.filter(F.array(*here), lambda m: m.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, m: a + m) / F.size(found))


def emotion_label(message: Column) -> Column:
    """struct(label, confidence) of the first rule that holds; emoji decide after all rules, without them the label is neutral."""
    low = F.lower(message)
    said = lambda label, sure: F.struct(F.lit(label).alias("label"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    out = F.when(message.rlike(LOUD) & _any(low, G.NEGATIVE), said("anger", 0.9))
    for label, sure, rule in EMOTION_RULES:
        out = out.when(_any(low, rule) if isinstance(rule, list) else low.rlike(rule), said(label, sure))
    mood = emoji_mood(message)
    strength = F.least(F.lit(0.8), F.abs(mood))
    return out.when(mood > 0.3, said("joy", strength)).when(mood < -0.3, said("sadness", strength)).otherwise(said("neutral", 0.3))


def padcn(label: Column) -> Column:
    """struct of the five axes of an emotion label, zeros for others."""
    axis = lambda k: F.coalesce(F.create_map(*[F.lit(x) for name, v in PADCN.items() for x in (name, v[k])])[label], F.lit(0.0))
    return F.struct(*[axis(k).alias(a) for k, a in enumerate(AXES)])


def reason(text: Column) -> Column:
    """The stated reason, null without one."""
    return F.nullif(trimmed(F.regexp_extract(text, REASON, 1)), F.lit(""))


def dated(text: Column, ts: Column) -> Column:
    """Relative dates replaced by absolute ones, counted from the row's own time."""
    for pattern, by in DATES:
        new = F.lit(by) if isinstance(by, str) else F.date_format(F.date_add(F.to_date(ts), by), "yyyy-MM-dd")
        text = F.regexp_replace(text, F.lit(pattern), new)
    return text


def code_symbols(message: Column, most: int = 2) -> Column:
    """Symbols in backticks and, where those are fewer than ``most``, camel-case and snake-case names; ``most`` in all."""
    quoted = F.array_distinct(F.regexp_extract_all(message, F.lit(BACKTICKED), F.lit(1)))
    names = F.filter(F.regexp_extract_all(message, F.lit(IDENTIFIER), F.lit(1)), lambda x: ~x.isin(NO_SYMBOLS))
    return F.slice(F.when(F.size(quoted) >= most, quoted).otherwise(F.array_distinct(F.concat(quoted, names))), 1, most)


def stack_frames(message: Column, most: int = 5) -> Column:
    """struct(error, frames): the first line that names an error and the first frames; null without a frame."""
    lines = F.filter(F.split(message, "\n"), lambda x: ~x.rlike(TRACEBACK))
    in_file = lambda x: F.when(x.rlike(FILE_FRAME), F.concat_ws(":", F.regexp_extract(x, FILE_FRAME, 1), F.regexp_extract(x, FILE_FRAME, 2))).otherwise("")
    frame = lambda x: F.when(x.rlike(AT_LINE), F.regexp_extract(x, AT_FRAME, 1)).otherwise(in_file(x))

    def parsed(x: Column) -> Column:
        frames = F.slice(F.filter(F.transform(x, frame), lambda f: f != ""), 1, most)
        error = F.get(F.filter(x, lambda y: y.rlike(ERROR_LINE)), F.lit(0))
        return F.when(F.size(frames) > 0, F.struct(F.coalesce(F.substring(trimmed(error), 1, 150), F.lit("")).alias("error"), frames.alias("frames")))

    return bound(lines, parsed)


def tier(age_seconds: Column) -> Column:
    """How a turn of that age is held: verbatim for five minutes (and without an age), a summary for an hour, then facts."""
    return F.when(age_seconds.isNull() | (age_seconds < 300), "verbatim").when(age_seconds < 3600, "summary").otherwise("compressed_fact")


STYLE = ["length", "questions", "code", "formality", "depth"]


def style_vector(text: Column) -> Column:
    """Array of the five style measures, in the order of ``STYLE``."""
    n = F.length(text)
    one = lambda x: F.least(F.lit(1.0), x)
    questions = F.regexp_count(text, F.lit("[？?]")) / F.greatest(F.lit(1.0), n / 100)
    return F.array(one(n / 2000), questions, F.when(F.contains(text, F.lit("```")), 1.0).otherwise(0.0), F.when(text.rlike("[的了吗呢吧啊]"), 0.3).otherwise(0.7), one(F.regexp_count(text, F.lit("\n")) / 20))


def vector_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)
