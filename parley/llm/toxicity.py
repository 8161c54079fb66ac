"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled rows (`per_class` ids of each class; features are
made on the executors, only their indices reach the driver) and runs the per-coordinate FTRL
updates in numpy. L1 leaves few weights other than zero; those, as (index, weight) arrays, are
broadcast. Scoring is one pass over whole texts without a shuffle.

A feature counts once per text. NULL and empty texts have no feature and get the score of the
bias. Without any labelled row of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import crc_remainder, labelled_sample, one_row_each, ship_package, texts_of
from parley.llm.hashing import batches, features

THRESHOLD = 0.3


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20          # feature space 2^bits
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 8
    per_class: int = 4000   # bound of the training sample, ids of each class
    mod: int = 4            # ids whose crc32 has remainder `held` modulo `mod` are never learned from
    held: int = 2
    seed: int = 17


@dataclass(frozen=True)
class Model:
    bias: float
    index: np.ndarray       # sorted
    weight: np.ndarray
    bits: int

    def score(self, texts: list[str]) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        if len(self.index):
            for a, b in batches(texts):
                doc, feature = features(texts[a:b], self.bits)
                at = np.minimum(np.searchsorted(self.index, feature), len(self.index) - 1)
                hit = self.index[at] == feature
                once = np.unique(doc[hit] * len(self.index) + at[hit])
                logit[a:b] += np.bincount(once // len(self.index), self.weight[once % len(self.index)], b - a)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def ftrl(examples: list[tuple[np.ndarray, int]], p: FtrlParams) -> Model:
    """Per-coordinate FTRL-proximal updates, one example at a time; the bias has no L1."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0

    def weights(s, was):
        return np.where(np.abs(s) <= p.l1, 0.0, -(s - np.sign(s) * p.l1) / ((p.beta + np.sqrt(was)) / p.alpha + p.l2))

    def of_bias():
        return -zb / ((p.beta + nb ** 0.5) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(examples)):
            i, y = examples[k]
            was = n[i]
            w, wb = weights(z[i], was), of_bias()
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -40, 40))) - y
            z[i] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / p.alpha * w
            n[i] = was + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / p.alpha * wb
            nb += g * g
    w = weights(z, n)
    index = np.flatnonzero(w)
    return Model(float(of_bias()), index, w[index], p.bits)


def train(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams(), label: str = "toxic") -> Model:
    ship_package(docs.sparkSession)
    ids = labelled_sample(labels, label, p.mod, p.held, p.per_class, p.seed)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(ids), "doc_id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = texts_of(b.column("text"))
            found = [np.unique(features([t], p.bits)[1]).astype(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("text_hash"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "y", "text_hash", "feature"])

    # one row of each id reaches the driver, however often an id is repeated
    got = one_row_each(rows.mapInArrow(run, "doc_id long, y int, text_hash long, feature array<int>"), "y", "feature").toArrow()
    order = pc.sort_indices(got, [("doc_id", "ascending"), ("y", "ascending")]).to_numpy()
    feature = got.column("feature").combine_chunks()
    flat, ends, y = feature.values.to_numpy(), feature.offsets.to_numpy(), got.column("y").to_numpy()
    examples = [(flat[ends[k]:ends[k + 1]], int(y[k])) for k in order]  # views of the one array of 32-bit indices
    if len({y for _, y in examples}) < 2:
        return Model(-40.0, np.zeros(0, dtype=np.int64), np.zeros(0), p.bits)
    model = ftrl(examples, p)
    del examples, flat, ends, feature, got
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(texts_of(b.column(1))))],
                                             names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def with_prediction(scored: DataFrame, mod: int, held: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score stays under the threshold, with all their columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield b.filter(pa.array(shared.value.score(texts_of(b.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
