"""Secrets in texts by a trigram inverted index over the documents.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The documents are indexed
in segments: each segment's postings map a trigram to the documents that hold it, the queries intersect and unite postings, and the
expression itself runs on the candidates alone. A rule whose expression has no mandatory trigram runs on every document. Only trigrams
that a query asks for get postings. A segment is indexed, queried and verified where its texts lie, so nothing is shuffled and a task
holds one segment of bounded size besides the texts of a batch; one longer text is a segment of its own.

Trigrams are of UTF-8 bytes with A-Z lowered, for which expressions are taken with ASCII case rules only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as node
from re import _parser as tree

from mnemoframe.llm.common import LOWER, give_back, row_chunks, text_buffer

SEGMENT_BYTES = 4 << 20
SET_MOST, STRINGS_MOST = 8, 64  # wider character classes and larger sets of strings count as unknown
SPANS = "array<struct<kind: string, start: int, end: int>>"


class Rule(NamedTuple):
    """A match counts if ``group`` has ``least`` characters or more; others are dropped, but have used up their text."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# The kinds in their order. "[0-9a-f]{16,}" finds what "[0-9a-f]+" with 16 characters or more does.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
# Published formats of keys and tokens.
FORMAT_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^/\x09-\x0D\x20:@]{1,64}:[^/\x09-\x0D\x20:@]{3,64}@"),
)
RULES = BASE_RULES + FORMAT_RULES

# A query is None (all documents), ("grams", frozenset) that all must occur, ("and", queries) or ("or", queries).
Query = tuple | None


class Info(NamedTuple):
    """What is known of an expression's matches: all of them (``exact``), or how they begin and end, and a query they all satisfy."""

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: Query


NOTHING, EMPTY = frozenset([b""]), Info(frozenset([b""]), frozenset([b""]), frozenset([b""]), None)
UNKNOWN = Info(None, NOTHING, NOTHING, None)


def all_of(*queries: Query) -> Query:
    parts = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def any_of(*queries: Query) -> Query:
    if not queries or None in queries:
        return None
    parts = tuple(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", parts)


def grams(text: bytes) -> frozenset:
    return frozenset(text[k] << 16 | text[k + 1] << 8 | text[k + 2] for k in range(len(text) - 2))


def holds_one(strings: frozenset) -> Query:
    """One of the strings occurs; known only where each has a trigram. A string that implies another's trigrams adds nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {grams(s) for s in strings}
    return any_of(*sorted((("grams", g) for g in sets if not any(h < g for h in sets)), key=lambda q: sorted(q[1])))


def loosened(info: Info) -> Info:
    """Not exact any more: the strings go into the query, of beginnings and ends stay the two bytes that a later trigram can use."""
    ends = info if info.exact is None else Info(None, info.exact, info.exact, info.query)
    query = all_of(ends.query, holds_one(ends.prefix), holds_one(ends.suffix))
    prefix, suffix = frozenset(s[:2] for s in ends.prefix), frozenset(s[-2:] for s in ends.suffix)
    return Info(None, prefix if len(prefix) <= STRINGS_MOST else NOTHING, suffix if len(suffix) <= STRINGS_MOST else NOTHING, query)


def pairs(left: frozenset, right: frozenset) -> frozenset:
    return frozenset(a + b for a in left for b in right)


def joined(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS_MOST:
        both = pairs(a.exact, b.exact)
        return Info(both, both, both, all_of(a.query, b.query))
    x, y = loosened(a), loosened(b)
    across = holds_one(pairs(x.suffix, y.prefix)) if len(x.suffix) * len(y.prefix) <= STRINGS_MOST else None
    prefix = pairs(a.exact, y.prefix) if a.exact is not None and len(a.exact) * len(y.prefix) <= STRINGS_MOST else x.prefix
    suffix = pairs(x.suffix, b.exact) if b.exact is not None and len(x.suffix) * len(b.exact) <= STRINGS_MOST else y.suffix
    return Info(None, prefix, suffix, all_of(x.query, y.query, across))


def either(infos: list[Info]) -> Info:
    if all(i.exact is not None and i.query is None for i in infos):
        exact = frozenset().union(*(i.exact for i in infos))
        if len(exact) <= STRINGS_MOST:
            return Info(exact, exact, exact, None)
    loose = [loosened(i) for i in infos]
    prefix, suffix = (frozenset().union(*s) for s in ([i.prefix for i in loose], [i.suffix for i in loose]))
    return loosened(Info(None, prefix, suffix, any_of(*(i.query for i in loose))))


def of_chars(chars: set[int]) -> Info:
    strings = frozenset(chr(c).encode().lower() if c < 128 else chr(c).encode() for c in chars)
    return Info(strings, strings, strings, None)


def of_class(members: list) -> Info:
    chars: set[int] = set()
    for op, value in members:
        if op is node.LITERAL:
            chars.add(value)
        elif op is node.RANGE and value[1] - value[0] < SET_MOST:
            chars.update(range(value[0], value[1] + 1))
        else:  # a category, a wide range, or all but the members
            return UNKNOWN
    return of_chars(chars) if len(chars) <= SET_MOST else UNKNOWN


def of_sequence(items) -> Info:
    out = EMPTY
    for op, value in items:
        out = joined(out, of_node(op, value))
    return out


def of_node(op, value) -> Info:
    if op is node.LITERAL:
        return of_chars({value})
    if op is node.IN:
        return of_class(value)
    if op is node.SUBPATTERN:
        return of_sequence(value[3])
    if op is node.ATOMIC_GROUP:
        return of_sequence(value)
    if op is node.BRANCH:
        return either([of_sequence(b) for b in value[1]])
    if op in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT):
        least, most, inner = value
        if (least, most) == (0, 1):
            return either([EMPTY, of_sequence(inner)])
        out = EMPTY
        for _ in range(min(least, 3)):
            out = joined(out, of_sequence(inner))
        return out if least == most <= 3 else joined(out, UNKNOWN)
    if op in (node.AT, node.ASSERT, node.ASSERT_NOT):
        return EMPTY  # takes no text; what it demands is left to the verification
    return UNKNOWN


def trigram_query(pattern: str) -> Query:
    """A query that every text with a match satisfies; None if the expression has no mandatory trigram."""
    return loosened(of_sequence(tree.parse(pattern, re.ASCII))).query


def wanted(query: Query) -> frozenset:
    if query is None:
        return frozenset()
    return query[1] if query[0] == "grams" else frozenset().union(*map(wanted, query[1]))


@lru_cache(maxsize=4)
def lookup(trigrams: frozenset) -> np.ndarray:
    """For each of the 2**24 trigrams its number from 1 among the sorted ``trigrams``, else 0."""
    table = np.zeros(1 << 24, np.uint8 if len(trigrams) < 256 else np.uint16)
    table[sorted(trigrams)] = np.arange(1, len(trigrams) + 1)
    return table


def postings(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, trigrams: frozenset) -> dict[int, np.ndarray]:
    """Of rows lo..hi of a text buffer: for each of ``trigrams`` that occurs the ascending numbers, from 0, of the rows with it."""
    base = int(offsets[lo])
    low = LOWER[data[base : int(offsets[hi])]].astype(np.uint32)
    if len(low) < 3 or not trigrams:
        return {}
    number = lookup(trigrams)[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
    at = np.flatnonzero(number)
    ends = offsets[lo : hi + 1] - base
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + 3 <= ends[row + 1]  # not across two texts
    keys = np.unique(number[at[inside]].astype(np.int64) << 32 | row[inside])
    names, firsts = np.unique(keys >> 32, return_index=True)
    order = sorted(trigrams)
    return {order[n - 1]: rows & 0xFFFFFFFF for n, rows in zip(names.tolist(), np.split(keys, firsts[1:]))} if len(keys) else {}


def candidates(query: Query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Rows of a segment of ``n`` that satisfy the query; intersections begin with the shortest posting list."""
    if query is None:
        return np.arange(n)
    if query[0] == "or":
        return np.unique(np.concatenate([candidates(q, index, n) for q in query[1]]))
    none = np.zeros(0, np.int64)
    lists = [index.get(g, none) for g in query[1]] if query[0] == "grams" else [candidates(q, index, n) for q in query[1]]
    lists.sort(key=len)
    out = lists[0]
    for rows in lists[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, rows, assume_unique=True)
    return out


def matches(rule: Rule, regex: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in regex.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def segment_spans(column: pa.Array, rules: tuple[Rule, ...], segment_bytes: int) -> Iterator[list[list[tuple[int, int, int]]]]:
    """Per segment, per row: (start, number of the rule, end) of all spans, ascending."""
    regexes = [r.regex for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = frozenset().union(*map(wanted, queries))
    data, offsets = text_buffer(column)
    for lo, hi in row_chunks(offsets, segment_bytes):
        index = postings(data, offsets, lo, hi, trigrams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
        texts: dict[int, str] = {}
        for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
            for row in candidates(query, index, hi - lo).tolist():
                if row not in texts:
                    texts[row] = str(memoryview(data[int(offsets[lo + row]) : int(offsets[lo + row + 1])]), "utf-8")
                found[row] += [(a, k, b) for a, b in matches(rule, regex, texts[row])]
        yield [sorted(f) for f in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per row of ``docs``: ``key`` and spans, array of (kind, start, end) by start, then by the rules' order.

    Spans count code points, ends are exclusive. Each rule's matches are leftmost and don't overlap; those of different rules may. Nulls
    and empty texts have no spans, a null key stays null, repeated rows are returned as often as they come, other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([r.kind for r in rules])
        for batch in batches:
            at = 0
            for rows in segment_spans(batch.column(1), rules, segment_bytes):
                flat = np.array([s for row in rows for s in row], np.int32).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
                firsts = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(at, len(rows)), pa.ListArray.from_arrays(pa.array(firsts), parts)], [key, "spans"])
                at += len(rows)
        give_back()

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *[count(r.kind) for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``[kind]`` of its first one; ``found`` has one row for each key.

    A null key has no spans to be found by, so its text stays; a null text stays null.
    """
    spans = found.where(F.size("spans") > 0).select(F.col(key).alias("_secret_key"), F.col("spans").alias("_secret_spans")).dropDuplicates(["_secret_key"])
    state = "struct<at: int, out: string>"
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).alias("out"))
    )
    shown = F.aggregate("_secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    with_spans = docs.join(spans, docs[key] == spans["_secret_key"], "left")
    return with_spans.select(*[(F.coalesce(shown, F.col(text)).alias(text) if c == text else docs[c]) for c in docs.columns])
