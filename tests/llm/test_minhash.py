"""b-bit MinHash near-duplicates against all pairs, and on odd rows."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from parley.llm import minhash
from parley.llm.minhash import MinHashParams

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}


def brute(rows):
    """Row number -> component's smallest doc_id."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(docs_of, rows, **kw):
    got = minhash.near_duplicates(docs_of(rows), MinHashParams(**kw)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def chain(rng, n, words=60, edits=3):
    """Copies of copies: neighbours are similar, the ends are not."""
    w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        for i in rng.sample(range(words), edits):
            w[i] = "".join(rng.choice("abcdefgh") for _ in range(6))
    return out


@pytest.mark.parametrize("kw", [{}, {"partners": 1, "star_rounds": 1, "block": 7}])
def test_components_equal_all_pairs(docs_of, kw):
    rng = random.Random(3)
    base = chain(rng, 1, 80)[0].split()
    texts = chain(rng, 25) + chain(rng, 25, 30, 1)
    for _ in range(60):  # a group of near copies of one text, about half of whose pairs are under 0.8
        w = list(base)
        for i in rng.sample(range(len(w)), rng.randint(2, 6)):
            w[i] = rng.choice(["x", "yy", "zzz"]) * 3
        texts.append(" ".join(w))
    passage = " ".join(f"w{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(8, 40))) for _ in range(60)]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    check(docs_of, rows, **kw)


def test_odd_rows(docs_of):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "One"), (5, "one"), (None, "one"), (4, "a b"), (3, "A\tB"), (4, "a b"), (None, "no id at all"),
            (2, "same word " * 20_000), (1, "same word"), (11, "É é"), (10, "é é"), (20, "x y z"), (21, "x y z"), (22, "x\x1cy z")]
    check(docs_of, rows)
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_minima_do_not_depend_on_batches(monkeypatch):
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, 1 + 37 * i, dtype=np.uint64)) for i in range(20)]
    whole = minhash.minima(sets, 16, 3)
    monkeypatch.setattr(minhash, "HASHES_AT_ONCE", 10)
    assert (minhash.minima(sets, 16, 3) == whole).all()
    monkeypatch.setattr(minhash, "WORDS_AT_ONCE", 7)
    text = " ".join(f"w{i % 23}" for i in range(100))
    assert len(minhash.shingle_set(text, 2)) == len(brute_set(text))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_estimate_is_corrected_for_chance(spark, bits):
    rng = np.random.default_rng(0)
    p, rows, want = MinHashParams(bits=bits), [], []
    for share in (0.0, 0.3, 0.6, 0.8, 1.0):
        for _ in range(30):
            common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(1000 * share), 1000 - int(1000 * share), 1000 - int(1000 * share)))
            sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
            least = minhash.minima(sets, p.bands * p.rows, p.seed)
            sig = minhash.packed(least, bits)
            rows.append((sig[0].tolist(), sig[1].tolist()))
            want.append(len(np.intersect1d(*sets)) / len(np.union1d(*sets)))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash.estimate("a", "b", p).alias("e")).collect()
    off = np.array([r.e for r in got]) - np.array(want)
    assert abs(off.reshape(5, 30).mean(axis=1)).max() < 0.03 and abs(off).max() < 0.35 / bits ** 0.5


def test_far_fewer_pairs_than_all_in_a_group(spark, docs_of, monkeypatch):
    """Near copies of one text: comparisons grow with the rows, not with their square."""
    rng = random.Random(5)
    base = chain(rng, 1, 150)[0].split()
    rows = []
    for d in range(600):
        w = list(base)
        for i in rng.sample(range(len(w)), rng.randint(1, 4)):
            w[i] = f"n{d}x{i}"
        rows.append((d, " ".join(w)))
    compared, confirm = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets, p: (compared.append(pairs.count()), confirm(pairs, sets, p))[1])
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(compared) < 20 * len(rows)
