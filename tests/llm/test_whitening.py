"""Whitening against numpy on the whole fit list, and its defined cases."""

import numpy as np
import pytest

from mnemoframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, dims string, packed string"


def brute(vectors, most=16):
    x = np.array(sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.asarray((x * n - sums) / n, float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-10 * e[0]).sum()))
    return n, sums, e[:k], u[:, :k], np.trace(v)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, e, u, trace = brute([r.embedding for r in rows])
    got = {}
    for r in queries.op13(spark, sf).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(rows)
    signs = None
    for r in rows:
        mine = sorted(got[r.vec_id], key=lambda a: a.component)
        x = np.floor(64 * np.array(r.embedding, float)).astype(int) + 1_000_000
        exact = [n * int(a) - int(s) for a, s in zip(x, sums)]
        want = (np.array(exact, float) / n) @ u / np.sqrt(e)
        w = np.array([a.whitened for a in mine])
        signs = np.sign(w * want) if signs is None else signs
        assert [a.component for a in mine] == list(range(1, 17)) and {a.n for a in mine} == {n}
        assert {a.deviation for a in mine} == {sum(d * d for d in exact)}
        assert np.allclose(w * signs, want, atol=1e-6) and np.allclose([a.explained for a in mine], e / trace, rtol=1e-6)
        assert mine[0].identity_error < 1e-8


def test_defined_cases(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(40, 3)).round(2)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(k, vectors[0]) for k in range(100, 160)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]), (204, []), (205, [1.0]), (206, [1.0, 2.0]), (None, vectors[1]), (207, [3e38, -3e38, 1.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    got = whitening.whiten(df.where("coalesce(vec_id, 0) <> 207")).collect()
    assert sorted((r.vec_id for r in got), key=repr) == sorted([*range(40), *range(100, 160), None], key=repr)
    assert len({(tuple(r.whitened), r.deviation) for r in got if r.vec_id in (0, *range(100, 160))}) == 1
    assert {r.n for r in got} == {len({tuple(np.floor(64 * np.float32(v).astype(float))) for v in vectors})}
    assert len(got[0].whitened) == 3 and got[0].identity_error < 1e-8
    wide = {r.vec_id: r for r in whitening.whiten(df).collect()}  # entries that only Python's integers hold, squared
    assert wide[207].deviation is None or wide[207].deviation > 10**30
    assert whitening.by_component(whitening.whiten(df)).where("vec_id = 207").first().deviation is None


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    assert whitening.by_component(whitening.whiten(df)).count() == 0


def test_packing_and_rows_alone():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-100, 100, (50, 5)), rng.integers(-(2**30), 2**30, (50, 5)), rng.integers(-(2**60), 2**60, (50, 5))]) + whitening.BASE
    import pyarrow as pa

    back = np.concatenate(list(whitening.unpack(pa.array(whitening.pack(x), pa.binary()), 5)))
    assert (back == x).all() and len({len(p) for p in whitening.pack(x)}) == 3
    c, w = rng.normal(size=(1000, 64)), rng.normal(size=(64, 16))
    whole = whitening.project(c, w)
    for size in (1, 7, 333):
        assert all((whitening.project(c[k : k + size], w) == whole[k : k + size]).all() for k in range(0, 1000, size))
