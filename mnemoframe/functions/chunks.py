"""Chunkers and extractive compression: Column -> Column, by higher-order functions. Empty texts give no chunk, null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def packed(parts: Column, joiner: str, most: int) -> Column:
    """Neighbouring parts joined while the next still fits into ``most`` characters; a longer part stands alone."""
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        held, done = acc["held"], acc["done"]
        full = (F.length(held) > 0) & (F.length(held) + F.length(part) > most)
        longer = F.when(F.length(held) == 0, part).otherwise(F.concat(held, F.lit(joiner), part))
        return F.struct(F.when(full, F.concat(done, F.array(trimmed(held)))).otherwise(done).alias("done"), F.when(full, part).otherwise(longer).alias("held"))

    def close(acc: Column) -> Column:
        return F.when(trimmed(acc["held"]) == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(trimmed(acc["held"]))))

    return F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("held")), step, close)


def by_paragraph(text: Column, most: int = 500, least: int = 10) -> Column:
    """Paragraphs packed; packs over ``most`` are cut at sentence ends and packed again; ``least`` characters or fewer go."""
    paragraphs = packed(F.split(text, r"\n\n+"), "\n\n", most)
    cut = F.transform(paragraphs, lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(packed(F.split(c, r"[。！？.!?\n]+"), "。", most)))
    return F.filter(F.flatten(cut), lambda c: F.length(c) > least)


def by_heading(text: Column, most: int = 500, least: int = 10) -> Column:
    """Sections that begin at second-level headings; those over ``most`` by paragraph."""
    sections = F.split(text, r"(?m)^(?=##\s)")
    each = F.transform(sections, lambda s: F.when(F.length(s) > most, by_paragraph(s, most, least)).when(F.length(trimmed(s)) > least, F.array(trimmed(s))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(sections) <= 1, by_paragraph(text, most, least)).otherwise(F.flatten(each))


# Names of sections that mark a paper.
PAPER_MARKERS = ["abstract", "introduction", "conclusion", "references", "methodology", "related work"]


def is_paper(text: Column) -> Column:
    return sum((text.rlike(rf"(?im)^\s*(?:\d+\.?\s*)?{m}").cast("int") for m in PAPER_MARKERS), F.lit(0)) >= 3


# What counts as a word and as an entity in a sentence.
WORD = r"([一-鿿]{2,}|[a-zA-Z]{3,})"
ENTITY = r"(\d+|`[^`]+`|[A-Z][a-z]+[A-Z]|[A-Z]{2,})"


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.lower)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def dense_sentences(text: Column, ratio: float = 0.4) -> Column:
    """The densest sentences up to ``ratio`` of the length, in their order; texts of two sentences or fewer stay."""
    sentences = F.filter(F.split(F.regexp_replace(text, r"([。！？!?.\n])\s*", "$1" + MARK), MARK), lambda s: F.length(trimmed(s)) > 3)

    def density(s: Column, edge: Column) -> Column:
        unique = bound(words(s), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))
        entities = 1 + F.least(F.regexp_count(s, F.lit(ENTITY)) * 0.2, F.lit(0.8))
        return unique * entities * F.when(edge, 1.2).otherwise(1.0) * F.when(F.length(s) < 10, 0.5).otherwise(1.0)

    def scored(found: Column) -> Column:
        return F.transform(found, lambda s, i: F.struct((-density(s, (i == 0) | (i == F.size(found) - 1))).alias("rank"), i.alias("i"), s.alias("s")))

    def take(acc: Column, x: Column) -> Column:
        room = acc["used"] < acc["goal"]
        kept = F.when(room, F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s"))))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.when(room, acc["used"] + F.length(x["s"])).otherwise(acc["used"]).alias("used"), acc["goal"].alias("goal"))

    start = F.struct(F.array().cast("array<struct<i:int,s:string>>").alias("kept"), F.lit(0).alias("used"), F.ceil(F.length(text) * F.lit(ratio)).alias("goal"))
    in_order = lambda acc: F.array_join(F.transform(F.sort_array(acc["kept"]), lambda x: x["s"]), " ")
    return bound(sentences, lambda found: F.when(F.size(found) <= 2, text).otherwise(F.aggregate(F.sort_array(scored(found)), start, take, in_order)))
