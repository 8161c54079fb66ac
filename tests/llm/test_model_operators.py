"""Encoders, token files, classifiers and top-k: round trips, brute force, held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parley.llm import quality, sentencepieces, simple8b, token_files, topk, toxicity
from parley.llm.queries import BYTE_BPE, PIECE_MODEL

ODD = [(1, None), (2, ""), (3, " x  y "), (None, "no id"), (4, "same"), (4, "same"), (5, "日本語🙂"), (6, "long" * 5000), (7, "a b " * 9000)]


# SentencePiece -------------------------------------------------------------------------------
def odd_texts():
    rng = random.Random(5)
    return (["a  b   c", " x ", "  ", "\n\n a\tb", "a" * 300, "thenationofthethe" * 40, "日本語テキスト" * 30 + "🙂", "▁▁a b▁c", "0123456789" * 50]
            + ["".join(rng.choice("aabeenrst  ,.\né▁🙂") for _ in range(rng.randint(1, 100))) for _ in range(60)])


@pytest.mark.parametrize("chunk", [7, 40])
def test_scan_equals_library(chunk):
    """Chunks cut anywhere, matrices combined in a tree, each chunk backtraced alone."""
    p = sentencepieces.pieces(PIECE_MODEL)
    for text in odd_texts():
        marked = sentencepieces.MARK + text.replace(" ", sentencepieces.MARK)
        parts = []
        for a in range(0, len(marked), chunk):
            left = min(a, p.longest + 1)
            parts.append((marked[a - left:a + chunk + p.longest], left, min(chunk, len(marked) - a)))
        states = sentencepieces.fix_borders([p.transfer(*x) for x in parts])
        got = np.concatenate([p.backtrace(*x, e, z) for x, (e, z) in zip(parts, states)])
        assert got.tolist() == p.sp.encode(text), text[:40]
        assert p.decode(got) == text.replace(sentencepieces.MARK, " ")


def test_encode_rows(docs_of):
    p = sentencepieces.pieces(PIECE_MODEL)
    rows = ODD + [(100 + i, t) for i, t in enumerate(odd_texts()[:20])]
    got = sentencepieces.encode(docs_of(rows), PIECE_MODEL, chunk=64).collect()  # many texts take the parallel scan
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in got))) == sorted(
        map(str, ((i, p.sp.encode(t) if t else []) for i, t in rows)))
    coded = sentencepieces.encode(docs_of(rows), PIECE_MODEL)
    back = {r.doc_id: r.decoded for r in sentencepieces.decode(coded, PIECE_MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert sentencepieces.encode(docs_of([]), PIECE_MODEL).collect() == []


# token files ---------------------------------------------------------------------------------
def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 3000):
        for top in (0, 1, 50257, 2**20, 2**60, 2**64 - 1):
            v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            assert (simple8b.unpack_blocks(*simple8b.pack_blocks(v, 1000)) == v).all()
    mixed = np.concatenate([np.zeros(500, np.uint64), rng.integers(0, 2**64 - 1, 50, dtype=np.uint64), np.ones(300, np.uint64)])
    rng.shuffle(mixed)
    words, offsets = simple8b.pack_blocks(mixed, 100)
    assert (simple8b.unpack(words[offsets[3]:offsets[4]]) == mixed[300:400]).all()  # any block alone


def test_encoder_equals_library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", " ", "\n", "a  b", "x \n \ny", "a\n\n  b  c", "it's  don't 's\n't", "　 a", "<|endoftext|> a<|endoftext|>", "tab\t x", "a.b ,c .d",
             "e.g. x,y", "\n.y", "x ,y"]
    texts += ["".join(rng.choice("ab1.,' \n\té'sS🙂") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    got = token_files.encoder(BYTE_BPE).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_takes_arrow_slices():
    """Words are cut in the bytes of an Arrow array, part of it included; white space beyond ASCII is found."""
    enc, rng = token_files.encoder(BYTE_BPE), random.Random(8)
    texts = ["".join(rng.choice(" \n.,aZ\u3000\u00a0\u2003\u0085\x1cé日") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for kind in (pa.string(), pa.large_string()):
        part = pa.array(["left out", *texts, "too"], kind).slice(1, len(texts))
        assert [g.tolist() for g in enc.encode(part)] == [w.tolist() for w in enc.fresh(texts)]
    _, odd = token_files.cuts(*token_files.text_bytes(pa.array(texts)))
    assert {i for i, t in enumerate(texts) if token_files.INNER_SPACE.search(t)} <= set(odd.tolist())


def test_token_files_in_id_order(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE_BPE)
    rows = [(i, t) for i, t in ODD if i is not None] + [(-3, "first"), (50, "x\ny.")]
    random.Random(7).shuffle(rows)
    token_files.write(docs_of(rows), str(tmp_path / "t"), BYTE_BPE)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    want = {(i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows}
    assert {(r.doc_id, zlib.crc32(r.ids)) for r in got} == want
    token_files.write(docs_of([]), str(tmp_path / "e"), BYTE_BPE)
    assert token_files.read(spark, str(tmp_path / "e")).collect() == []


# classifiers ---------------------------------------------------------------------------------
def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable")) + 1
    pos = np.asarray(y) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("operator, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.75)])
def test_held_out_ranking(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = operator.NetParams() if operator is quality else operator.FtrlParams()
    model = operator.train(docs, labels, p)
    rows = toxicity.with_prediction(operator.score(docs, model), p.mod, p.held).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % p.mod == p.held for r in rows)
    assert auc([r[label] for r in rows], [r.score for r in rows]) >= least


@pytest.mark.parametrize("operator, params", [(quality, quality.NetParams()), (toxicity, toxicity.FtrlParams())])
def test_scores_of_odd_rows(spark, docs_of, operator, params):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = operator.train(docs_of(ODD), none, params)  # nothing to learn from
    got = toxicity.with_prediction(operator.score(docs_of(ODD), model), params.mod, params.held).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) == 1
    assert operator.score(docs_of([]), model).collect() == []


def test_long_texts_score_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    net = quality.Net(rng.normal(size=(5, 256, 4)).astype(np.float32), np.zeros(4), rng.normal(size=4), 0.1, 8)
    raw = bytes(rng.integers(0, 256, 1000, dtype=np.uint8))
    whole = net.half_chunks(raw)
    monkeypatch.setattr(quality, "PIECE", 24)
    assert np.array_equal(net.half_chunks(raw), whole) and len(whole) == 125


# top-k ---------------------------------------------------------------------------------------
def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    v += [(300 + i, v[0][1]) for i in range(60)]                       # many equal vectors
    v += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (None, v[0][1]),
          (405, []), (410, [2.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in e] for i, e in v
            if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in ints if i % 100 == 0 or i == 404):
        found = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q and len(e) == len(ints[q]))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:10])}
    queries = df.where("vec_id % 100 = 0 OR vec_id = 404")
    for block in (4096, 2):
        got = topk.top_k(df, queries, block=block, bins=16).collect()
        assert {tuple(r) for r in got} == want
    assert topk.top_k(df.where("vec_id < 0"), queries.where("vec_id < 0")).collect() == []


def test_topk_large_components_stay_exact():
    a, b = np.array([[2**40, 3]], dtype=np.int64), np.array([[2**21, 5]], dtype=np.int64)
    assert topk.scores(a, b).tolist() == [[2**61 + 15]]


def test_models_are_where_the_package_says():
    assert PIECE_MODEL == public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("module, learn", [(quality, "fit"), (toxicity, "ftrl")])
def test_training_takes_one_row_of_each_id(spark, monkeypatch, module, learn):
    docs = spark.createDataFrame([(i, f"text {i} of {k}") for i in range(40) for k in range(25 if i < 3 else 1)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(module, learn, lambda examples, p: seen.append(examples))
    module.train(docs, labels)
    p = (quality.NetParams if module is quality else toxicity.FtrlParams)()
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % p.mod != p.held for i in range(40))
