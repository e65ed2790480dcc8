"""Kernels against brute force, without Spark."""

import collections
import functools
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.llm import decontamination as D
from mnemoframe.llm import langid, linededup, njaccard, packing, queries, repetition, warc
from mnemoframe.llm.common import Words, shingles, text_buffer
from mnemoframe.llm.learners import Boosted, Isotonic, Logistic

TEXTS = st.lists(st.text(alphabet="ab é\n\t ", max_size=60), max_size=6)


@given(TEXTS)
@settings(deadline=None)
def test_words(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    if texts:
        w = Words(data, offsets, 0, len(texts))
        assert w.counts.tolist() == [len(t.encode().split()) for t in texts]
        words = [x.decode() for t in texts for x in t.encode().split()]
        assert w.n_chars.tolist() == list(map(len, words))
        by = collections.defaultdict(set)
        for h, x in zip(w.hash.tolist(), words):
            by[x].add(h)
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def longest(ws):
    same = lambda i, j: next((k for k in range(len(ws)) if i + k >= len(ws) or j + k >= len(ws) or ws[i + k] != ws[j + k]), 0)
    return [max([0, *(same(i, j) for j in range(len(ws)) if j != i)]) for i in range(len(ws))]


@given(TEXTS.filter(bool))
@settings(deadline=None)
def test_longest_repeats(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    w = Words(data, offsets, 0, len(texts))
    assert repetition.longest_repeats(w.row, w.hash).tolist() == sum((longest(t.encode().split()) for t in texts), [])


def test_measure():
    run = " ".join(f"w{k}" for k in range(10))
    texts = [f"{run} x {run}", "a | b #", "same\n \nsame\nsame", ""]
    data, offsets = text_buffer(pa.array(texts))
    m = repetition.measure(Words(data, offsets, 0, 4), texts, 8)
    assert m["n_repeat_words"].tolist() == [20, 0, 0, 0]
    assert m["n_symbols"].tolist() == [0, 2, 0, 0]
    assert m["n_dup_lines"].tolist() == [0, 0, 2, 0]
    assert m["longest_repeat"].tolist()[0] == 10


@given(st.lists(st.text("ab字𝄞 ", max_size=60), min_size=1, max_size=4))
@settings(deadline=None)
def test_unspaced_text_against_brute_force(texts):
    texts = [t + "字" * 3 + "abcdefghijklmnopqrstuvwxyzéü字母0123456789𝄞!?" * 2 for t in texts]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    w = Words(data, offsets, 0, len(texts))
    m = repetition.measure(w, texts, 2)
    for k, text in enumerate(texts):
        units = [u for x in text.split(" ") if x for u in ([(c,) for c in x] if len(x) > repetition.LONG_WORD else [x])]  # a character of a long word is no word
        size = [u for x in text.split(" ") if x for u in ([1] * len(x) if len(x) > repetition.LONG_WORD else [6])]
        found = longest(units)
        words = [sum(size[i : i + n]) // 6 for i, n in enumerate(found)]
        inside = {j for i, n in enumerate(found) if words[i] >= 2 for j in range(i, i + n)}
        assert m["longest_repeat"][k] == max(words) and m["covered_chars"][k] == sum(len(units[j]) for j in inside)


def test_repeats_without_spaces():
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, n))
    block = prose(300)
    texts = [prose(500) + block + prose(100) + block, prose(1200)]
    data, offsets = text_buffer(pa.array(texts))
    m = repetition.measure(Words(data, offsets, 0, 2), texts, 8)
    assert m["covered_chars"].tolist() == [600, 0] and m["longest_repeat"].tolist() == [50, 0]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
@settings(deadline=None)
def test_plan_holds_every_piece(counts):
    groups = packing.plan_lengths(counts, 60)
    held = collections.Counter()
    for content, many in groups:
        assert sum(content) <= 60 and many > 0
        for n in content:
            held[n] += many
    assert held == collections.Counter(counts)
    places = packing.places(groups)
    spans = collections.defaultdict(list)
    for n, c in counts.items():
        first, seq, off = places[n]
        for rank in range(c):
            k = np.searchsorted(first, rank, "right") - 1
            spans[int(seq[k] + rank - first[k])].append((int(off[k]), n))
    for parts in spans.values():  # gapless from 0
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    counts = collections.Counter(rng.randint(1, 4096) for _ in range(20000))
    assert sum(m for _, m in packing.plan_lengths(counts)) <= 1.02 * sum(k * v for k, v in counts.items()) / 4096


def test_tokenizer_memory_gives_the_tokenizers_ids():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = ["", "  ", "Don't you'll IT'S 12.5% x²½ª", "ÀÉ ß straße", "<|endoftext|> a<|startoftext|>b", "日本語 Σας", "İstanbul ﬁ—“q”", "a\u0085b\x1cc", "­x­", "word " * 5000]
    plain = tokenizers.Tokenizer.from_file(path)
    got = packing.ChunkTokenizer(path).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


ODD_TEXTS = st.lists(st.text(alphabet="aBsTrevLlmd'é½²ªßÀ×÷<|.!1 \n\t\x1c\x85\xa0\xad\u0301\u2014\u017f語", max_size=30), max_size=6)


@settings(max_examples=300, deadline=None)
@given(ODD_TEXTS)
def test_parts_are_cut_as_by_the_tokenizer(texts):
    mine = made_tokenizer()
    assert [g.tolist() for g in mine.encode(pa.array(texts, pa.string()))] == [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@functools.cache
def made_tokenizer():
    return packing.ChunkTokenizer(queries.tokenizer_path())


def test_full_tokenizer_memory_keeps_the_words_in_use(monkeypatch):
    """The model is asked once for each new part, whatever its case and punctuation, and again only for those long out of use."""
    monkeypatch.setattr(packing, "CACHE_PARTS", 1000)
    monkeypatch.setattr(packing, "CACHE_WORDS", 1000)
    mine = packing.ChunkTokenizer(queries.tokenizer_path())
    asked = []
    tokenize, by_model = mine.tokenize, getattr(mine, "_model_ids", None)
    mine.tokenize = lambda part: asked.append(part) or tokenize(part)
    if by_model:
        mine._model_ids = lambda parts: asked.extend(parts) or by_model(parts)
    names = ["".join("abcdefghij"[int(d)] for d in str(10_000 + k)) for k in range(3_600)]
    texts = []
    for k in range(6):
        mixed = [x for n in names[:300] for x in (n, n.upper() + ",")] + [f"{n}é" for n in names[600 * k : 600 * (k + 1)]]
        random.Random(k).shuffle(mixed)
        texts.append(" ".join(mixed))
    got = [mine.encode(pa.array([t]))[0].tolist() for t in texts]
    assert got == [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == 301 + 3_600


def test_odd_chunks_beside_plain_ones(monkeypatch):
    """Through a memory of odd chunks that is full again and again."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    mine = packing.ChunkTokenizer(queries.tokenizer_path())
    rng = random.Random(3)
    for _ in range(20):
        texts = [" ".join(rng.choice(["Plain,", "don't", "x²", "語" * rng.randrange(1, 9), f"—{rng.randrange(99)}", "<|endoftext|>"]) for _ in range(rng.randrange(30))) for _ in range(6)] + [None, "é only"]
        want = [mine.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in mine.encode(pa.array(texts, pa.string()))] == want


def test_a_model_without_end_marks():
    mine = packing.ChunkTokenizer(queries.tokenizer_path())
    mine.is_end[:] = False
    texts = ["Don't é, été 12", "", "straße"]
    assert [g.tolist() for g in mine.encode(pa.array(texts))] == [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_memory_is_small():
    """Two workers beside an executor's heap hold such memories, so each has room for some 100 MB."""
    import tracemalloc

    mine = packing.ChunkTokenizer(queries.tokenizer_path())
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghij"))
    texts = pa.array([" ".join(map("".join, letters[rng.integers(0, 10, (20_000, 9))])) for _ in range(25)])
    mine.encode(texts.slice(0, 1))
    tracemalloc.start()
    for k in range(len(texts)):
        mine.encode(texts.slice(k, 1))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(mine.known) > 50_000 and held < 60e6


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    other = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    other.normalizer = tokenizers.normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    mine = packing.ChunkTokenizer(str(tmp_path / "other.json"))
    assert not mine.chunked
    assert [g.tolist() for g in mine.encode(pa.array(["Ab  c", None, ""]))] == [other.encode(t, add_special_tokens=False).ids for t in ("Ab  c", "", "")]


def fewest_sequences(lengths, capacity):
    """By brute force over all ways of putting pieces into sequences."""
    best = len(lengths)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + lengths[k] <= capacity and loads[i] not in loads[:i]:
                place(k + 1, [*loads[:i], loads[i] + lengths[k], *loads[i + 1 :]])
        place(k + 1, [*loads, lengths[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 30), max_size=9))
@settings(deadline=None, max_examples=150)
def test_plan_against_the_optimum(lengths):
    made = sum(m for _, m in packing.plan_lengths(collections.Counter(lengths), 30))
    assert made <= fewest_sequences(sorted(lengths, reverse=True), 30) + 1


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != x), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def test_decontamination_equals_full_alignment():
    rng = random.Random(5)
    for _ in range(25):
        items = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randint(10, 110))) for _ in range(3)]
        texts = []
        for _ in range(4):
            x = list(rng.choice(items))
            for _ in range(rng.randint(0, 9)):
                p = rng.randrange(len(x))
                x[p : p + rng.randint(0, 1)] = rng.choice(["", "z"])
            texts.append(D.normalised("".join(rng.choice("abcdefgh ij") for _ in range(rng.randint(0, 150))) + "".join(x) + "abc"))
        index = D.build_index(list(enumerate(items)), 8, 10)
        got = {(r, k): e for r, k, _, _, e, _ in D.matches(texts, index)}
        for r, t in enumerate(texts):
            for k, item in enumerate(index.texts):
                e = edits(item, t)
                assert got.get((r, k)) == (e if e <= (index.budget[k] if len(item) >= 16 else 0) else None)


def test_patience():
    assert linededup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 4, 5]) == [(1, 1), (2, 2), (3, 4), (4, 5)]
    assert linededup.common_lines([1, 2, 3], [7, 1, 2, 8, 3], [5, 15, 15, 9, 5], 20) == [1, 2]
    assert linededup.patience([], [1]) == [] and linededup.patience([4, 4, 4], [4, 4]) == [(0, 0), (1, 1)]
    many = [1] * 3000
    assert len(linededup.patience(many, many[:2000])) == 2000


def repeated_lines(a, b, words_b, least):
    """By brute force: the lines of b in a block of consecutive lines of at least ``least`` words that a holds."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words_b[j : j + n]) >= least:
                out |= set(range(j, j + n))
    return sorted(out)


LINES = st.lists(st.integers(0, 4), max_size=14)


@given(LINES, LINES, st.integers(1, 12))
@settings(deadline=None, max_examples=300)
def test_common_lines_are_all_repeated_blocks(a, b, least):
    words = [3 * x % 5 for x in b]  # 0 for a blank line
    assert linededup.common_lines(a, b, words, least) == repeated_lines(a, b, words, least)


def phrases_of(text, labelled):
    """By brute force: each phrase is the longest match that begins where the last ended, or one symbol."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in labelled:
            k += 1
        n, at = n + 1, at + k
    return n


def test_cross_parsing():
    a = langid.Automaton(np.array([0, 1, 0, 2]), 4)  # abac
    for text, phrases in (("abac", 1), ("abacba", 2), ("cc", 2), ("cab", 2), ("ad", 2), ("dda", 3)):
        grid = np.array([["abcd".index(c) for c in text]], np.uint16).T
        assert a.phrases(grid, np.array([len(text)])).tolist() == [phrases] == [phrases_of(text, "abac")]


@given(st.text("abcdé ", max_size=80), st.lists(st.text("abcdé? ", max_size=90), min_size=1, max_size=4), st.sampled_from([1, 2, 7, 512]))
@settings(deadline=None, max_examples=200)
def test_segments_change_nothing(labelled, texts, segment):
    plain = lambda t: "".join(" " if c == 0 else chr(c) for c in langid.letters(t).tolist())
    rates = langid.Parser({"x": labelled, "y": "abcabd"}, segment).rates(texts)
    for k, t in enumerate(texts):
        for j, known in enumerate((labelled, "abcabd")):
            if any(map(str.isalpha, t)):
                assert rates[k, j] == phrases_of(plain(t), plain(known)) / len(plain(t))
            else:
                assert np.isnan(rates[k, j])


def test_evenly():
    assert langid.evenly(["aaaa", "b", "cccc"], 7) == ["aaa", "b", "ccc"] and langid.evenly([], 5) == [] and langid.evenly(["ab"], 5) == ["ab"]


def test_warc_reader_frames_and_verifies():
    import zlib

    def packed(data):
        p = zlib.compressobj(6, zlib.DEFLATED, 31)
        return p.compress(data) + p.flush()

    one, two = warc.record(1, "http://x/é y", b"a" * 300_000, None), warc.record(2, None, b"", None)
    got = list(warc.read_records(io.BytesIO(packed(one) + packed(two))))
    assert [f["WARC-Type"] for f, _ in got] == ["response"] * 2 and len(got[0][1]) > 300_000
    for bad in (packed(one)[:-20], packed(one.replace(b"aaa", b"aab", 1)), packed(one + b"x")):
        with pytest.raises(warc.Corrupt):
            list(warc.read_records(io.BytesIO(bad)))


def brute_links(sets, percent):
    n = len(sets)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


@pytest.mark.parametrize("leaf", [4, 64])
def test_region_join_is_exact(monkeypatch, leaf):
    monkeypatch.setattr(njaccard, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(15):
        base = [set(rng.sample(range(300), 40)) for _ in range(6)]
        sets = [set(rng.sample(sorted(b), rng.randint(30, 40))) | set(rng.sample(range(300), rng.randint(0, 6))) for b in rng.choices(base, k=60)]
        s = njaccard.Sets([np.array(sorted(x), np.uint64) for x in sets], 75)
        s.join(np.arange(len(sets)))
        assert [s.root(k) for k in range(60)] == brute_links(sets, 75)


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_partners_of_linked_sets_are_wanted(percent):
    """At their first shared shingle, linked sets want each other's size; most places of sets that are unlike in size do not."""
    rng = np.random.default_rng(percent)
    table = rng.integers(0, 3, 1 << njaccard.LEVEL_BITS).astype(np.uint8)
    bit = lambda n: 1 << (int(njaccard.size_class(n, percent)) % 64)
    linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 200))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[int(rng.integers(0, n // 4 + 1)) : n], pool[n : n + int(rng.integers(0, n // 4 + 1))]]))
        same = len(np.intersect1d(a, b))
        if 100 * same < percent * (len(a) + len(b) - same):
            continue
        linked += 1
        firsts = [njaccard.first_shingles(x, table, percent).tolist() for x in (a, b)]
        shared = next(x for x in firsts[0] if x in set(firsts[1]))
        for x, first, other in ((a, firsts[0], b), (b, firsts[1], a)):
            wants = njaccard.partner_masks(len(x), len(first), percent)
            assert int(wants[first.index(shared)]) & bit(len(other)) & ((1 << 64) - 1)
    assert linked > 30
    assert not any(int(x) & bit(400) for x in njaccard.partner_masks(100, 20, percent))


def test_accidental_meetings_end_where_they_are(spark):
    """Sets of unlike sizes with a common shingle do not meet, others do, whatever the slices."""
    sizes = {1: 100, 2: 400, 3: 390, 4: 100}
    bit = lambda n: int(np.uint64(1 << (int(njaccard.size_class(n, 75)) % 64)).view(np.int64))
    rows = [(shingle % 2, shingle, sid, bit(sizes[sid]), int(njaccard.partner_masks(sizes[sid], 1, 75)[0])) for shingle, sids in ((10, (1, 2)), (11, (2, 3)), (12, (1, 2, 3)), (13, (4, 4, 2))) for sid in sids]
    firsts = spark.createDataFrame(rows, "slice int, shingle long, sid long, own long, wants long")
    assert sorted(map(tuple, njaccard.meetings(firsts, 2).collect())) == [(1, 2, 1), (1, 3, 1), (2, 2, 1), (2, 3, 1), (2, 4, 2)]


def test_short_texts_have_one_shingle():
    data, offsets = text_buffer(pa.array(["a b", "", "a b c d e f", None]))
    rows, _ = shingles(Words(data, offsets, 0, 4), 5)
    assert sorted(rows.tolist()) == [0, 2, 2]


def test_learners():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    m = Boosted(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.95
    p = Isotonic(m.margin(x), y)(np.sort(m.margin(x)))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    w = Logistic(x, (x[:, 2] > 0).astype(float))
    assert ((w.margin(x) > 0) == (x[:, 2] > 0)).mean() > 0.97
