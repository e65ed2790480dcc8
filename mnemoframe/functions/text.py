"""Text expressions: Column -> Column, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.chunks import bound

CJK = r"[一-鿿]"


# Characters that two together make no term for scoring.
CJK_STOPS = "的了是在我你他不有这那就也和但"


def _cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({CJK}+)"), F.lit(1))


def _windows(run: Column, size: int) -> Column:
    return F.when(F.length(run) >= size, F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substr(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Distinct tokens: two-character windows over CJK runs (and runs of 3 or 4 whole) first, then lower-case Latin words and digits."""
    return F.array_distinct(all_tokens(text))


def bigram_tokens(text: Column) -> Column:
    """``tokens`` and, after each but the last, it and the next joined by an underscore."""
    each = lambda t: F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.when(i < F.size(t) - 1, F.array(F.get(t, i), F.concat_ws("_", F.get(t, i), F.get(t, i + 1)))).otherwise(F.array(F.get(t, i)))))
    return bound(tokens(text), lambda t: F.when(F.size(t) > 0, each(t)).otherwise(F.array().cast("array<string>")))


def all_tokens(text: Column) -> Column:
    """The tokens of ``tokens`` with their repetitions."""
    windows = F.flatten(F.transform(_cjk_runs(text), lambda s: F.concat(_windows(s, 2), F.when(F.length(s).between(3, 4), F.array(s)).otherwise(F.array().cast("array<string>")))))
    return F.concat(windows, latin_words(text))


def scoring_terms(text: Column) -> Column:
    """Terms with their repetitions: CJK windows of two (not of two stop characters) and of three characters, then Latin words and digits."""
    windows = F.flatten(F.transform(_cjk_runs(text), lambda s: F.concat(F.filter(_windows(s, 2), lambda w: ~w.rlike(f"^[{CJK_STOPS}]{{2}}$")), _windows(s, 3))))
    return F.concat(windows, latin_words(text))


def overlap_words(text: Column) -> Column:
    """Distinct whole CJK runs of two characters or more, Latin words and digits."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(rf"({CJK}{{2,}})"), F.lit(1)), latin_words(text)))


def latin_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([a-zA-Z]{2,}|\d+)"), F.lit(1)), F.lower)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-case text with single spaces; none under three characters."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    # the characters are taken apart once: a substring by position would walk the text from its start each time
    three = lambda c, i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))
    return bound(F.split(t, ""), lambda c: F.when(F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: three(c, i)))).otherwise(F.array().cast("array<string>")))


def _sizes(a: Column, b: Column, f) -> Column:
    """``f`` of the sizes of a, b and what they share; each argument is computed once."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: bound(F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("both")), lambda n: f(n["a"], n["b"], n["both"])))


def jaccard(a: Column, b: Column) -> Column:
    return _sizes(a, b, lambda m, n, both: F.when((m == 0) | (n == 0), F.lit(0.0)).otherwise(both / (m + n - both)))


def dice(a: Column, b: Column) -> Column:
    return _sizes(a, b, lambda m, n, both: F.when(m + n == 0, F.lit(0.0)).otherwise(2 * both / (m + n)))


def estimated_tokens(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.ceil(1.5 * cjk + 0.4 * (F.length(text) - cjk))


def language_family(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit(CJK)) > 0.3 * F.regexp_count(text, F.lit("[a-zA-Z]")), "zh").otherwise("en")


# Word patterns.
WORD_PATTERNS = {"cjk2_en3": "[一-鿿]{2,}|[a-zA-Z]{3,}", "cjk24_en2_num": r"[一-鿿]{2,4}|[a-zA-Z]{2,}|\d+", "cjk24_en3": "[一-鿿]{2,4}|[a-zA-Z]{3,}"}


def pattern_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_PATTERNS[pattern]})"), F.lit(1))


def script_language(text: Column) -> Column:
    """Language by the first script that over 15 % of the characters belong to, else English."""
    size = F.greatest(F.length(text), F.lit(1))
    out = None
    for language, letters in (("ja", "[\u3040-\u30ff]"), ("ko", "[\uac00-\ud7af]"), ("zh", "[\u4e00-\u9fff]"), ("ru", "[\u0400-\u04ff]"), ("ar", "[\u0600-\u06ff]")):
        found = F.regexp_count(text, F.lit(letters)) / size > 0.15
        out = F.when(found, language) if out is None else out.when(found, language)
    return out.otherwise("en")


def strip_html(html: Column) -> Column:
    out = html
    for pattern, by in ((r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), (r"[\s]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


# Patterns of personal data.
PII = [r"\b1[3-9]\d{9}\b", r"\b\d{17}[\dXx]\b", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"(?i)\b(?:sk-|api[_-]?key|token|secret|password)[=:]\s*\S+", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"]
# Patterns of instructions that try to take over the memory.
POISON = [r"(?i)\bignore\s+(all\s+)?previous\b", "忽略(之前|上面|所有)(的)?指令", r"(?i)\byou\s+(are|must|should)\s+now\b", r"(?i)\bfrom\s+now\s+on\b", r"(?i)\bnew\s+(instructions?|rules?|persona)\s*:", r"(?i)\bsystem\s*prompt\s*:", r"(?i)\boverride\s+(all|system|safety|rules)\b", "你(现在|必须|应该)(是|变成|扮演)", r"(?i)\[INST\]|\[SYS\]|<<SYS>>|<\|im_start\|>"]


def matches_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def injects_memories(message: Column) -> Column:
    """Whether memory recall runs for a message: not for bare acknowledgements, long fenced code or commands."""
    short = (F.length(message) < 5) & message.rlike(r"(?i)^(ok|好|嗯|哦|行|是|对|恩|mm|hm|yeah|yep|sure|got it)")  # fixed values
    code = message.startswith("```") & message.endswith("```") & (F.size(F.split(message, "\n")) > 10)
    return ~(short | code | F.trim(message).rlike(r"^[!/]"))
