"""Repair of conversation structure by shortest paths over small integer costs.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in pairs. Its rows, by turn, are turned
into one at least cost: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and repeated rows must go), Insert an empty user or
assistant turn 3, and 3 more for each truncated row that stays. The nodes are (rows used, state of the wanted form). Dial's queue of
buckets finds every node's distance to the end; a walk over tight arcs that takes the ASCII-least letter at each step gives the least of
the cheapest audits. What role an R or I gives follows from the state, so an audit fixes the repaired rows.

How it spreads: rows are first counted by (conversation, turn, role, digest of the text), which merges copies before the shuffle; the
first turn of each (conversation, role, digest) is sorted in as a marker just before its row, so no join meets a hot key. Sorted by range,
a conversation is cut into blocks of bounded rows and bytes wherever it lies, and a hot one covers many partitions. Blocks become 4 x 4
matrices of least costs between states; one pass from a conversation's end carries the four distances over its blocks, all blocks are then
walked side by side from each state they can begin in, and one pass from its start picks the states that occur. Both passes hold one
block's figures. Texts join in at the end, once for each kept row.

Defined cases: null roles and texts are one space; turns sort nulls first, equal turns by role, then by the SHA-256 of the text, whatever
the order of the input; a null conv_id is a conversation of its own; equal rows of a turn are copies, of which all but the first are
duplicates; a role's initial is its first character, of an empty role nothing; an empty table gives no conversations. Other columns are
not read. ``audit`` is one value and SHA-256 is sequential by its definition: the first is put together, the second streamed, from the
pieces that blocks have prepared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # what has been written: nothing, the system turn, a user turn, a whole pair
STATES, FAR = range(4), 1 << 60
AT_END = [0, 2 * INSERT, INSERT, 0]  # from each state, when no row is left
TAIL = ["", "II", "I", ""]
LEGAL = {"su", "ua", "au"}
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
ORDER = ["turn", "role", "digest"]


def next_state(state: int, role: str) -> int | None:
    if role == "s":
        return SYSTEM if state == BEGIN else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def arcs_of(code: str) -> dict[str, list[tuple[int, int, int]]]:
    """Arcs over one row as letter -> (state, next state, cost). A code is a row's initial, upper case if truncated; x must go, o is another role."""
    out = {"D": [(s, s, DELETE) for s in STATES], "K": [], "R": []}
    if code != "x":
        more = TRUNCATED * code.isupper()
        out["K"] = [(s, t, more) for s in STATES if (t := next_state(s, code.lower())) is not None]
        out["R"] = [(s, t, REROLE + more) for s in STATES for role in "ua" if (t := next_state(s, role)) is not None]
    return out


ARCS = {code: arcs_of(code) for code in "suaoSUAOx"}
INSERTS = [(s, t) for s in STATES for role in "ua" if (t := next_state(s, role)) is not None]
BACK = {code: [[(s, cost) for letter in "DKR" for s, t, cost in arcs[letter] if t == state] for state in STATES] for code, arcs in ARCS.items()}
BACK_INSERT = [[s for s, t in INSERTS if t == state] for state in STATES]
STEPS = {code: [[(letter, t, cost) for letter in "DIKR" for s, t, cost in ([(s, t, INSERT) for s, t in INSERTS] if letter == "I" else arcs[letter]) if s == state] for state in STATES] for code, arcs in ARCS.items()}
DEAREST = REROLE + TRUNCATED


def distances(codes: str, at_end: list[int]) -> list[int]:
    """Dial's algorithm from the end of a block backwards: node 4 * rows + state -> least cost to the end of the conversation.

    ``at_end`` has the distances of the states after the block's last row; insertions there are the next block's.
    """
    n = len(codes)
    out = [FAR] * (4 * n + 4)
    known = [d for d in at_end if d < FAR]
    if not known:
        return out
    now = min(known)
    size = max(DEAREST, max(known) - now) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    left = 0
    for s in STATES:
        if at_end[s] < FAR:
            out[4 * n + s] = at_end[s]
            buckets[at_end[s] % size].append(4 * n + s)
            left += 1
    while left:
        bucket = buckets[now % size]
        while bucket:
            v = bucket.pop()
            left -= 1
            if out[v] != now:
                continue  # reached at less cost since
            i, state = divmod(v, 4)
            if i:
                first = 4 * (i - 1)
                for s, cost in BACK[codes[i - 1]][state]:
                    if now + cost < out[first + s]:
                        out[first + s] = now + cost
                        buckets[(now + cost) % size].append(first + s)
                        left += 1
            if i < n:
                for s in BACK_INSERT[state]:
                    if now + INSERT < out[4 * i + s]:
                        out[4 * i + s] = now + INSERT
                        buckets[(now + INSERT) % size].append(4 * i + s)
                        left += 1
        now += 1
    return out


def matrix(codes: str) -> list[int]:
    """Least costs over a block from each state before to each state after it."""
    columns = [distances(codes, [0 if s == t else FAR for s in STATES])[:4] for t in STATES]
    return [columns[t][s] for s in STATES for t in STATES]


def before(costs: list[int], at_end: list[int]) -> list[int]:
    return [min(min(costs[4 * s + t] + at_end[t], FAR) for t in STATES) for s in STATES]


def walk(codes: str, dist: list[int], state: int) -> tuple[str, int]:
    """The least letters of tight arcs from ``state`` before the block to its end, and the state there."""
    i, letters = 0, []
    while i < len(codes):
        here = dist[4 * i + state]
        for letter, t, cost in STEPS[codes[i]][state]:
            j = i + (letter != "I")
            if here == cost + dist[4 * j + t]:
                letters.append(letter)
                i, state = j, t
                break
    return "".join(letters), state


class Block:
    """Consecutive rows of one conversation; ``key`` is where it begins."""

    def __init__(self, conv, key: tuple, seq: int, opens: bool):
        self.conv, self.key, self.seq, self.opens = conv, key, seq, opens
        self.codes, self.rows, self.size, self.kept = [], 0, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, role: str, digest: bytes, copies: int, code: str, fault: str | None, size: int) -> None:
        initial = role[:1]
        self.first = initial if self.first is None else self.first
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL) + (self.last is not None and self.last + initial not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault:
            setattr(self, fault, getattr(self, fault) + copies)
        self.codes.append(code * copies)
        self.rows += copies
        if code != "x":
            self.kept.append((turn, role, digest))
            self.size += size

    def record(self, closes: bool) -> tuple:
        codes = "".join(self.codes)
        costs = None if self.opens and closes else matrix(codes)  # a conversation of one block is walked from its end at once
        turns, roles, digests = map(list, zip(*self.kept)) if self.kept else ([], [], [])
        return (self.conv, *self.key, self.seq, (TaskContext.get().partitionId() << 32) + self.seq, codes, costs, turns, roles, digests, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.turns, self.least, self.most)


FIGURES = "blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, least long, most long"
BLOCKS = "turn long, role string, digest binary, seq long, block long, codes string, costs array<long>, kept_turns array<long>, kept_roles array<string>, kept_digests array<binary>, " + FIGURES
ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()} | {f"array<{k}>": pa.list_(t) for k, t in (("long", pa.int64()), ("int", pa.int32()), ("string", pa.string()), ("binary", pa.binary()))}


def arrow_batch(rows: list[tuple], schema: str, conv: pa.DataType) -> pa.RecordBatch:
    """Rows of (conv_id, columns of ``schema``)."""
    fields = [("conv_id", conv), *((name, ARROW[kind]) for name, kind in (f.split(" ") for f in schema.split(", ")))]
    return pa.record_batch([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def streamed(rows: Iterator[tuple], schema: str, kind: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as a row may stand for a whole block; ``kind`` holds the conversations' type once a row has come."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield arrow_batch(held, schema, kind[0])
            held = []
    if held:
        yield arrow_batch(held, schema, kind[0])


def incoming(batches: Iterator[pa.RecordBatch], kind: list[pa.DataType]) -> Iterator[tuple]:
    for batch in batches:
        kind[:] = [batch.schema.field("conv_id").type]
        yield from zip(*(c.to_pylist() for c in batch.columns))


def cut_blocks(rows: Iterator[tuple], block_rows: int) -> Iterator[tuple]:
    """Records of blocks from sorted rows (conv_id, turn, role, digest, marker, copies, blank, truncated, size)."""
    block, seq, marked, conv, seen = None, 0, None, None, False
    for c, turn, role, digest, marker, copies, blank, truncated, size in rows:
        if marker:
            marked = (c, turn, role, digest)
            continue
        if block is not None and c != block.conv:
            yield block.record(closes=True)
            block = None
        opens = seen and c != conv  # else rows of the partition before may be of this conversation
        conv, seen = c, True
        first = marked == (c, turn, role, digest)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        parts = [(copies, "x", "blank")] if blank else [(1, code.upper() if truncated else code, "truncated" if truncated else None)] * first + [(copies - first, "x", "duplicate")]
        for many, sign, fault in parts:
            while many:
                if block is not None and (block.rows >= block_rows or block.size >= BLOCK_BYTES):
                    yield block.record(closes=False)
                    block, opens = None, False
                if block is None:
                    block, seq = Block(c, (turn, role, digest), seq, opens), seq + 1
                now = min(many, block_rows - block.rows)
                block.add(turn, role, digest, now, sign, fault, size)
                many -= now
    if block is not None:
        yield block.record(closes=False)


def carry_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv_id, block, costs), last block first: the distances of the states after each block."""
    held, at_end, last = None, AT_END, None
    for conv, block, costs in rows:
        if held is None or conv != held[0]:
            held, at_end = (conv,), AT_END
        elif last is not None:
            at_end = before(last, at_end)
        last = costs
        yield conv, block, at_end


def walk_blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv_id, block, codes, at_end): distance, letters and state after the block for each state before it."""
    for conv, block, codes, at_end in rows:
        dist = distances(codes, at_end)
        found = [walk(codes, dist, s) if dist[s] < FAR else (None, None) for s in STATES]
        yield conv, block, dist[:4], [f[0] for f in found], [f[1] for f in found]


CHOSEN = "block long, block_no long, only boolean, entry int, audit string, written long, cost long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long"


def choose(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From a conversation's walked blocks in order: the state each begins in, its letters, rows written before it, and its figures.

    Adjacent rows of two blocks are counted with the later one; the letters after the last row are the last block's.
    """
    held, conv, state, number, written, last, most = None, None, BEGIN, 0, 0, None, None

    def release(closes: bool) -> tuple:
        block, entry, audit, before_, figures = held
        return (conv, block, number - 1, closes and number == 1, entry, audit + TAIL[state] * closes, before_, *figures)

    for c, block, dist, audits, exits, blank, duplicate, truncated, illegal, first, last_, turns, least, most_ in rows:
        if held is not None:
            yield release(c != conv)
        if held is None or c != conv:
            conv, state, number, written, last, most = c, BEGIN, 0, 0, None, None
        if last is not None:
            illegal += last + first not in LEGAL
        turns -= least is not None and least == most
        held = (block, state, audits[state], written, (dist[state] if not number else 0, blank, duplicate, truncated, illegal, turns, least, most_))
        written += len(audits[state]) - audits[state].count("D")
        state, number, last, most = exits[state], number + 1, last_, most if most_ is None else most_
    if held is not None:
        yield release(True)


ROWS = "block_no long, only boolean, place long, edit string, new_role string, turn long, role string, digest binary"


def written_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv_id, block_no, only, entry, audit, written, codes, kept_turns, kept_roles, kept_digests): the rows that are kept, reroled or inserted."""
    for conv, number, only, state, audit, place, codes, turns, roles, digests in rows:
        i = k = 0  # rows of the block, and of those that may stay
        for letter in audit:
            if letter == "I":
                state = next(t for s, t in INSERTS if s == state)
                yield conv, number, only, place, letter, "user" if state == USER else "assistant", None, None, None
                place += 1
                continue
            if letter != "D":
                state = next(t for s, t, _ in ARCS[codes[i]][letter] if s == state)
                yield conv, number, only, place, letter, roles[k] if letter == "K" else "user" if state == USER else "assistant", turns[k], roles[k], digests[k]
                place += 1
            k += codes[i] != "x"
            i += 1


def hash_pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """SHA-256 of each conversation's pieces, (conv_id, piece) in order, joined by line feeds."""
    conv, state = None, None
    for c, piece in rows:
        if state is None or c != conv:
            if state is not None:
                yield conv, state.hexdigest()
            conv, state = c, hashlib.sha256()
        else:
            state.update(b"\n")
        state.update(piece.encode())
    if state is not None:
        yield conv, state.hexdigest()


def mapped(df: DataFrame, f, schema: str, *args) -> DataFrame:
    """``f`` over the stream of each partition's rows; its first column is the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []
        yield from streamed(f(incoming(batches, kind), *args), schema, kind)

    return df.mapInArrow(run, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {schema}")


class Repaired(NamedTuple):
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of conversations with rows.
    ``rows``: conv_id, block_no, only, place, edit, turn, role, text of the repaired ones; place counts from 0, turn is null if inserted."""

    report: DataFrame
    rows: DataFrame


def lines_of(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> Repaired:
    lines = lines_of(turns)
    solid = F.expr(f"trim(trailing {SPACES} from text)")
    counted = lines.withColumn("_solid", solid).groupBy("conv_id", *ORDER).agg(
        F.count("*").alias("copies"), F.max(F.col("_solid") == "").alias("blank"), F.max(~F.right("_solid", F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.max(F.octet_length("text") + F.octet_length("role")).cast("long").alias("size")
    )
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    columns = ["conv_id", *ORDER, "marker", "copies", "blank", "truncated", "size"]
    marks = firsts.select("conv_id", *ORDER, F.lit(True).alias("marker"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("size"))
    placed = counted.withColumn("marker", F.lit(False)).select(columns).unionByName(marks).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER, F.desc("marker"))
    blocks = stored(mapped(placed, cut_blocks, BLOCKS, block_rows), "conversation-blocks")

    latest = blocks.select("conv_id", *ORDER, "seq", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", *[F.desc(c) for c in (*ORDER, "seq")])
    ends = mapped(latest.select("conv_id", "block", "costs"), carry_back, "block long, at_end array<long>")
    walked = mapped(blocks.select("conv_id", "block", "codes").join(ends.drop("conv_id"), "block").select("conv_id", "block", "codes", "at_end"), walk_blocks, "block long, dist array<long>, audits array<string>, exits array<int>")
    figures = [f.split(" ")[0] for f in FIGURES.split(", ")]
    inorder = blocks.select("conv_id", *ORDER, "seq", "block", *figures).join(walked.drop("conv_id"), "block").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "seq")
    chosen = stored(mapped(inorder.select("conv_id", "block", "dist", "audits", "exits", *figures), choose, CHOSEN), "conversation-audits")

    pieces = F.sort_array(F.collect_list(F.struct("block_no", "audit")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = chosen.groupBy("conv_id").agg(F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"), *sums, F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))

    inputs = chosen.select("block", "block_no", "only", "entry", "audit", "written").join(blocks.select("conv_id", "block", "codes", "kept_turns", "kept_roles", "kept_digests"), "block")
    edits = mapped(inputs.select("conv_id", "block_no", "only", "entry", "audit", "written", "codes", "kept_turns", "kept_roles", "kept_digests"), written_rows, ROWS)
    edit = F.struct("block_no", "only", "place", "edit", "new_role")
    # each kept row finds its text among the copies by one aggregation, in which copies merge before the shuffle
    told = lines.select("conv_id", *ORDER, "text", F.lit(None).cast(edits.select(edit.alias("e")).schema["e"].dataType).alias("e"))
    found = told.unionByName(edits.where("digest is not null").select("conv_id", *ORDER, F.lit(None).cast("string").alias("text"), edit.alias("e"))).groupBy("conv_id", *ORDER).agg(F.max("text").alias("text"), F.max("e").alias("e")).where("e is not null")
    rows = found.select("conv_id", "e.block_no", "e.only", "e.place", "e.edit", "turn", F.col("e.new_role").alias("role"), "text")
    inserted = edits.where("digest is null").select("conv_id", "block_no", "only", "place", "edit", "turn", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repaired(report, rows.unionByName(inserted))


def repaired_hashes(rows: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of each conversation's ``role:text`` lines; blocks are put together side by side, several to a conversation are streamed."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))), lambda s: s["line"])
    pieces = rows.groupBy("conv_id", "block_no", "only").agg(F.concat_ws("\n", lines).alias("piece"))
    alone = pieces.where("only").select("conv_id", F.sha2("piece", 256).alias("repaired_sha256"))
    parts = pieces.where("not only").repartition("conv_id").sortWithinPartitions("conv_id", "block_no").select("conv_id", "piece")
    return alone.unionByName(mapped(parts, hash_pieces, "repaired_sha256 string"))


def repair_report(original: DataFrame, turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id of ``original``: ``Repaired.report`` and the hash of the repaired rows; zeros and empty texts without rows."""
    done = repair(turns, block_rows)
    ids = original.select(F.col("conv_id").alias("id")).distinct()
    hashes = repaired_hashes(done.rows).withColumnRenamed("conv_id", "hashed")
    out = ids.join(done.report, ids["id"].eqNullSafe(done.report["conv_id"]), "left").drop("conv_id")
    out = out.join(hashes, out["id"].eqNullSafe(hashes["hashed"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of ``conv_id:turn`` modulo 20 deals them; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text")).withColumn("_deal", F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20)
    text = F.when(F.col("_deal") == 1, "").when(F.col("_deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = dealt.where("_deal <> 0").select("conv_id", "turn", F.when(F.col("_deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("if(_deal = 3, array(0, 1), array(0))")).alias("_copy"))
    return rows.drop("_copy")
