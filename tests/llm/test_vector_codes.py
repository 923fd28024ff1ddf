"""Vector codes against exact scans, and what the bounds save."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.llm import vector_codes as V


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 4), st.integers(1, 5))
def test_assign_is_exact(seed, k, groups, rounds):
    """Any history of codebooks, with ties: same entries and distances as a full scan, and valid bounds."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 7, (40, 2))
    history, code = [rng.integers(-6, 7, (k, 2))], None
    for by_rounds in (False, True):
        bound, stamp, hist, code = np.zeros((40, groups), np.float32), np.zeros((40, groups), np.uint8), history[:1], None
        for _ in range(rounds + 1):
            code, error, _ = V.assign(x, hist, code, bound, stamp, by_rounds)
            full = V.distances(x, hist[-1])
            assert (code == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
            hist = [*hist, hist[-1] + rng.integers(-1, 2, (k, 2))]


def test_net_moves_are_tighter():
    there = [np.array([[0, 0], [9, 9]]), np.array([[3, 0], [9, 9]]), np.array([[0, 0], [9, 9]])]
    assert V.moved(there, 2)[0].tolist() == [0, 0] and V.moved(there, 2, by_rounds=True)[0].tolist() == [6, 0]


def brute(rows, parts, entries, rounds):
    """The contract with plain Python integers."""
    kept = sorted((i, [int(np.floor(256 * float(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v))
    d = len(kept[0][1]) // parts
    part = lambda v, p: tuple(v[p * d : p * d + d])
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((dist(part(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(p, v)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), a in zip(kept, at[p], strict=True) if a == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts)), label) for i, v, label in kept]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted((i, c, e, total[label], sha) for i, c, e, label in out)


@pytest.mark.parametrize("n", [5, 150])
def test_encode(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))], int(i) % 3 or None) for i in rng.permutation(n)]
    rows += [(1000, None, 1), (1001, [1.0, float("nan")] * 4, 1), (1002, [1.0, None] * 4, 2), (1003, [float("inf")] * 8, 2), (1004, rows[0][1], 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    assert sorted(map(tuple, V.encode(df, 4, 16, 2).collect())) == brute(rows, 4, 16, 2)
    assert V.encode(df.filter("vec_id > 5000"), 4, 16, 2).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [0.0, 2.0], 1), (None, [1.0, 2.0], None), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in V.encode(df, 2, 4, 1).collect()}
    assert got == {(1, "0100", 0, 0), (1, "0000", 0, 0), (None, "0100", 0, 0)}
    with pytest.raises(Exception, match="too large"):
        V.encode(spark.createDataFrame([(1, [1e9, 2.0], 1)], df.schema), 2, 4, 1).collect()
    with pytest.raises(ValueError, match="equal parts"):
        V.encode(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], df.schema), 2, 4, 1)


def test_bounds_save_scans(spark):
    """On vectors with clusters most distances of later rounds are never computed, and net moves save more than summed ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 16] + 0.1 * rng.normal(size=8)], 0) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    full = 800 * 2 * 16
    scans = {by: V.train(df, 2, 16, 4, 4, by)[0].agg({"scanned": "sum"}).first()[0] for by in (False, True)}
    assert scans[False] <= scans[True] and scans[False] < full / 2, scans
    codes = V.encode(df, 2, 16, 4)
    back = {r.vec_id: r.embedding for r in V.decoded(codes, V.train(df, 2, 16, 4)[1]).collect()}
    assert np.mean([np.abs(np.array(back[i]) - v).max() < 0.6 for i, v, _ in rows]) > 0.95
