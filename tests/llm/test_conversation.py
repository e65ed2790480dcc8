"""Conversation repair against plain dynamic programming over strings, against SQL, and its blocks against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from mnemoframe.llm import conversation, queries

SF = "/root/testdata/sf0.001"
FORM = re.compile("(s?(ua)+)?")


def best(codes):
    """(cost, audit) of the cheapest edits, ties by the audit, from all prefixes' best by what has been written."""
    found = {"": (0, "")}  # the form written so far, of which only the last roles matter
    short = lambda w: w if len(w) < 2 else w[-1] if w[-1] == "u" else "ua"

    def insert(states):
        for _ in range(3):
            for w, (c, a) in list(states.items()):
                for r in "ua":
                    if FORM.fullmatch(w + r) or FORM.fullmatch(w + r + "a"):
                        k = short(w + r)
                        states[k] = min(states.get(k, (9**9, "")), (c + 3, a + "I"))
        return states

    for code in codes:
        new = {}

        def put(w, value):
            new[w] = min(new.get(w, (9**9, "")), value)

        for w, (c, a) in insert(found).items():
            put(w, (c + 4, a + "D"))
            if code == "x":
                continue
            late = 3 * code.isupper()
            for role, letter, cost in ((code.lower(), "K", 0), ("u", "R", 3), ("a", "R", 3)):
                x = w + role
                if role in "sua" and any(FORM.fullmatch(x + rest) for rest in ("", "a", "ua")) and not (role == "s" and w):
                    put(short(x), (c + cost + late, a + letter))
        found = new
    return min(v for w, v in insert(found).items() if FORM.fullmatch(w))


def through_blocks(codes, size):
    parts = [codes[k : k + size] for k in range(0, len(codes), size)] or [""]
    rows = [(1, k, p, conversation.matrix(p)) for k, p in enumerate(parts)]
    ends = {b: e for _, b, e in conversation.carry_back((c, b, m) for c, b, _, m in reversed(rows))}
    walked = list(conversation.walk_blocks((c, b, p, ends[b]) for c, b, p, _ in rows))
    chosen = list(conversation.choose((*w, 0, 0, 0, 0, "u", "a", 0, None, None) for w in walked))
    return sum(r[7] for r in chosen), "".join(r[5] for r in chosen)


def test_paths_against_programming():
    for n in range(4):
        for codes in itertools.product("suaoSUAx", repeat=n):
            assert through_blocks("".join(codes), 9) == best(codes)
    rng = random.Random(4)
    for _ in range(400):
        codes = "".join(rng.choices("suaoSUAOx", weights=[1, 4, 4, 1, 1, 1, 1, 1, 2], k=rng.randint(0, 40)))
        assert through_blocks(codes, 50) == best(codes) == through_blocks(codes, rng.choice([1, 2, 3, 7]))


def brute(rows):
    """The contract's columns by plain Python from (turn, role, text) after the damage."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
    cost, audit = best(codes)
    out, i = [], 0
    for letter in audit:
        if letter != "D":
            role = "assistant" if out and out[-1].startswith("u") else "user"
            out.append(role + ":" if letter == "I" else rows[i][1] + ":" + rows[i][2] if letter == "K" else role + ":" + rows[i][2])
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    one = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = "user" if deal == 4 else one(role), "" if deal == 1 else re.sub("[.!?]", "", one(text)) if deal == 2 else one(text)
        for _ in range((1, 2)[deal == 3] if deal else 0):
            yield conv, turn, role, text


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


@pytest.mark.parametrize("source", ["table", "made"])
def test_query(spark, tmp_path, source):
    """Whole table, and made rows with nulls, ties, copies, foreign roles and a conversation with most of the rows: brute force and SQL."""
    rng = random.Random(8)
    sf = SF
    if source == "made":
        roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
        texts = ["a.", "b!", "open", "", None, " \t", "é?", "\n", "x" * 5000 + ".", "tail \x0b", "a "]
        rows = [(rng.choice([1, 2, 3, None, 4, 9, 9, 9]), rng.choice([*range(30), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{k}.", "extra", 1) for k in range(400)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string, block long").write.parquet(str(tmp_path / "conversations.parquet"))
        sf = str(tmp_path)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = by_conversation(damage(rows))
    want = {(conv, *brute(after.get(conv, []))) for conv in {r[0] for r in rows}}
    df = queries.op11(spark, sf)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet{'' if source == 'table' else '/*.parquet'}'")
    assert set(con.execute(queries.ORACLE_SQL["op11_conversation_repair"]).fetchall()) == want


@pytest.mark.parametrize("block_rows", [1, 3, 8])
def test_blocks(spark, block_rows):
    """Blocks of few rows, cut by many partitions: copies, hot conversations and turns across borders, nothing changes."""
    rng = random.Random(block_rows)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([*range(40), None]), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", "", f"t{k}."])) for k in range(300)] + [(7, 5, "user", "same.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repair_report(df, df, block_rows).collect()}
    assert got == {conv: brute(mine) for conv, mine in by_conversation(rows).items()}
    repaired = conversation.repair(df, block_rows).rows.where("conv_id = 1").orderBy("place").collect()
    assert [r.place for r in repaired] == list(range(len(repaired))) and FORM.fullmatch("".join(r.role[0] for r in repaired))


def test_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.repair_report(empty, empty).count() == 0
    one = spark.createDataFrame([(5, 0, "user", "x")], empty.schema)
    assert [tuple(r) for r in conversation.repair_report(one, empty).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
