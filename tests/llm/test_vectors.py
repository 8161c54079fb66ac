"""Whitening and vector codes against direct computation, and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from parley.llm import cover_tree, whitening
from parley.llm.cover_tree import CodeParams
from parley.llm.whitening import Moments, WhiteningParams

ODD = [(1, None, 0), (2, [1.0, None, 2.0, 3.0] * 2, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, None), (5, [], 2), (6, [1.0, 2.0], 2),
       (7, [1e300] * 8, 3)]
SCHEMA = "vec_id long, embedding array<float>, label int, component string"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def made(rng, n, d=8):
    v = rng.normal(size=(n, d)) * np.geomspace(3, 0.05, d) + 0.3
    return [(i, [float(np.float32(x)) for x in row], int(i) % 3 if i % 7 else None) for i, row in enumerate(v)]


def whole(rows, scale, shift=0):
    return np.array([[int(np.floor(scale * float(np.float32(c)))) + shift for c in v] for _, v, _ in rows], dtype=np.int64)


# whitening -----------------------------------------------------------------------------------
@pytest.mark.parametrize("p", [WhiteningParams(components=3, guard=2), WhiteningParams()])
def test_whitening_equals_eigh(spark, p):
    rows = made(np.random.default_rng(0), 300)
    rows += [(500 + i, rows[0][1], 1) for i in range(100)] + [(0, rows[1][1], 0), (None, rows[2][1], 0)]  # copies, repeated and missing ids
    got = whitening.whiten(frame(spark, rows + ODD), p).collect()
    x = whole(rows, 64, 1_000_000)
    c = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(c.T @ c / len(x))
    k = min(p.components, 8)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    want = c @ vector / np.sqrt(value)
    assert len(got) == len(rows) * k and {r.n for r in got} == {len(rows)}
    assert all(r.identity_error < 1e-9 for r in got)
    assert all(abs(r.explained - value[r.component - 1] / np.trace(c.T @ c / len(x))) < 1e-10 for r in got)
    exact = {i: sum(int(v) ** 2 for v in len(x) * row.astype(object) - x.astype(object).sum(axis=0)) for (i, _, _), row in zip(rows, x)}
    for comp in range(1, k + 1):
        of = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == comp)
        mine = np.array([w for *_, w in of])
        theirs = [sorted((i is None, i or 0, s * w) for (i, _, _), w in zip(rows, want[:, comp - 1])) for s in (1, -1)]
        assert min(np.abs(mine - np.array([w for *_, w in t])).max() for t in theirs) < 1e-8
    # equal ids have two deviations; the others one
    assert all(r.deviation == exact[r.vec_id] for r in got if r.vec_id != 0)


def test_whitening_without_variance(spark):
    v = [0.5, -2.0, 3.25, 0.0]
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, ODD[:5])).collect() == []
    assert whitening.whiten(frame(spark, [(i, v, 0) for i in range(9)])).collect() == []
    line = whitening.whiten(frame(spark, [(i, [float(i), 1.0, 2.0 * i], 0) for i in range(5)])).collect()  # one direction only
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12 and len(line) == 5


def test_filter_separates_close_values():
    """A spectrum without a gap behind the wanted pairs, through the pass interface alone."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    value = np.linspace(1.0, 0.7, 64)
    v = q @ np.diag(value) @ q.T
    passes = []
    got, vec = whitening.eigenpairs(lambda b: (passes.append(1), v @ b)[1], 64, WhiteningParams())
    assert np.abs(got - value[:32]).max() < 1e-12 and np.abs(np.abs((vec * q[:, :32]).sum(axis=0)) - 1).max() < 1e-9
    assert len(passes) < 200
    with pytest.raises(RuntimeError):
        whitening.eigenpairs(lambda b: v @ b, 64, WhiteningParams(rounds=2))


def test_moments_are_exact_for_large_numbers():
    x = np.array([[2**40 + 3, -5], [2**40 - 1, 7], [2**40, 1]], dtype=np.int64)
    m = Moments(3, x.astype(object).sum(axis=0))
    assert m.deviations(x).tolist() == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.astype(object).sum(axis=0))) for row in x]
    assert np.abs(m.centred(x) - np.array([[7 / 3, -6], [-5 / 3, 6], [-2 / 3, 0]])).max() < 1e-12
    with pytest.raises(OverflowError):
        Moments(3, np.array([0, 0], dtype=object)).deviations(x)


# vector codes --------------------------------------------------------------------------------
def brute_codes(x, ids, parts, entries, rounds):
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))[:entries]
    out, books = [], []
    for k in range(parts):
        part = x[:, k * width:(k + 1) * width]
        book = part[order].copy()
        for r in range(rounds + 1):
            d = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if r < rounds:
                for e in set(near.tolist()):
                    book[e] = part[near == e].sum(axis=0) // (near == e).sum()
        out.append((near, d.min(axis=1)))
        books.append(book)
    return np.stack([n for n, _ in out], axis=1), sum(e for _, e in out), np.stack(books)


@pytest.mark.parametrize("d, entries, chunk", [(8, 16, 512), (6, 5, 7), (8, 256, 40)])
def test_codes_equal_all_distances(spark, d, entries, chunk):
    rng = np.random.default_rng(3)
    rows = made(rng, 200, d)
    rows += [(900 + i, rows[5][1], 1) for i in range(150)] + [(0, rows[1][1], 0), (None, rows[2][1], 0)]
    cluster = [(2000 + i, [float(np.float32(50 + 40 * (i % 4) + x)) for x in rng.normal(size=d) * 0.01], 2) for i in range(120)]  # whole subtrees
    rows += cluster
    p = CodeParams(entries=entries, chunk=chunk)
    coded, books = cover_tree.compress(frame(spark, rows + ODD), p)
    got = cover_tree.with_label_error(coded).collect()
    x = whole(rows, 1024)
    code, error, want = brute_codes(x, [i for i, *_ in rows], 4, entries, 4)
    assert (books == want).all() and len(got) == len(rows)
    sums = {}
    for (_, _, label), e in zip(rows, error):
        sums[label] = sums.get(label, 0) + int(e)
    expected = sorted((str(i), "".join(f"{c:02x}" for c in row), int(e), sums[label]) for (i, _, label), row, e in zip(rows, code, error))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == expected


def test_codes_without_vectors(spark):
    for rows in ([], ODD[:5]):
        coded, books = cover_tree.compress(frame(spark, rows))
        assert cover_tree.with_label_error(coded).collect() == [] and books.size == 0


def test_trees_hold_their_points_and_assign_subtrees():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-9, 9, (200, 4)) + 10_000 * k for k in range(5)] + [np.full((50, 4), 7)])
    rng.shuffle(x)
    t = cover_tree.build(x)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for v in range(len(t.lo)):
        own = t.order[t.lo[v]:t.hi[v]]
        assert np.sqrt(((x[own] - x[own[0]]) ** 2).sum(axis=1)).max() <= t.radius[v]
        if t.n[v]:
            kids = range(t.first[v], t.first[v] + t.n[v])
            assert [t.lo[c] for c in kids] + [t.hi[v]] == [t.lo[v]] + [t.hi[c] for c in kids]
    book = np.array([[10_000 * k] * 4 for k in range(5)] + [[7, 7, 7, 8]])
    subtrees, leaves, _ = cover_tree.assign(x, t, book)
    assert sum(hi - lo for lo, hi, _ in subtrees) >= 800 and len(leaves) < 210  # whole clusters go at once
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (cover_tree.codes(x, t, book) == d.argmin(axis=1)).all()
    back = cover_tree.Tree.unpacked(t.packed())
    assert all((getattr(back, f) == getattr(t, f)).all() for f in cover_tree.FIELDS)


def test_large_distances_stay_exact():
    a = np.array([[2**29, 3]], dtype=np.int64)
    assert cover_tree.squared(a, np.array([[0, 1], [1, 1]])).tolist() == [[2**58 + 4, (2**29 - 1) ** 2 + 4]]
    with pytest.raises(OverflowError):
        cover_tree.squared(np.array([[2**40]]), np.array([[0]]))
