"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query; per query a histogram of the scores is summed over
the cluster, the bin that holds the k-th value becomes the next range, and so on until the range is
a single integer. A last pass keeps the scores above that value and, of those equal to it, the
smallest ids. A task sends only its highest bins down to its own k-th value (lower ones cannot hold
the global one) and at most k equal scores a query, so hot values and many equal vectors add nothing.

Queries go out in blocks of about `block` vectors, the size bound of what is broadcast; each block
reads all candidates. A vector's components become floor(1024 * x). Vectors that are NULL, hold a
NULL or a component that is not finite, or come without an id take no part; vectors of another
length are no candidates for a query. Empty vectors score 0. A repeated id as query counts once
(its smallest vector); as candidate every row counts. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import ship_package

BLOCK = 4096
BINS = 512
CELLS = 1 << 22  # scores held at a time
NONE = np.iinfo(np.int64).min  # score of a pair that does not count


def quantised(ids: pa.Array, vectors: pa.Array, scale: int = 1024) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (ids, integer matrix) of the vectors that take part."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    starts = vectors.offsets.to_numpy()[:-1] if len(vectors) else np.zeros(0, dtype=int)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL reads as NaN
    known, out = ~np.asarray(ids.is_null()), {}
    key = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero((sizes == n) & known)
        m = flat[starts[at][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(at), 0))
        good = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(scale * m[good])
        if (np.abs(m) >= 2.0**62).any():
            raise ValueError("a scaled component does not fit a long")
        out[int(n)] = (key[at[good]], m.astype(np.int64))
    return out


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by float64 where every partial sum fits 53 bits."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if most < 2.0**53:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return (c.astype(object) @ q.T.astype(object)).astype(np.int64)  # OverflowError beyond a long


class Block:
    """One block of queries by length, sorted by id, with its own number for every query."""

    def __init__(self, table: pa.Table):
        self.ids: list[int] = []
        self.by: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        merged = table.combine_chunks()
        if merged.num_rows:
            found = quantised(merged.column("vec_id").chunk(0), merged.column("embedding").chunk(0))
            for n, (ids, m) in found.items():
                order = np.lexsort((*m.T[::-1], ids))
                ids, m = ids[order], m[order]
                once = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else order
                self.by[n] = (ids[once], m[once], len(self.ids))
                self.ids += ids[once].tolist()

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(candidate ids, scores, number of the first query) in bounded pieces."""
        for b in batches:
            for n, (ids, m) in quantised(b.column(0), b.column(1)).items():
                if n not in self.by:
                    continue
                qids, q, first = self.by[n]
                step = max(1, CELLS // max(1, len(qids)))
                for a in range(0, len(ids), step):
                    key, s = ids[a:a + step], scores(m[a:a + step], q)
                    at = np.minimum(np.searchsorted(qids, key), len(qids) - 1)
                    own = np.flatnonzero(qids[at] == key)
                    s[own, at[own]] = NONE
                    yield key, s, first


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of every query's k highest candidates, ties to the
    smaller id; both frames hold vec_id and embedding."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    blocks = max(1, math.ceil(asked.count() / block))
    out = None
    for i in range(blocks):
        part = Block(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow())
        found = _search(rows, part, k, bins)
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, part: Block, k: int, bins: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(part)
    n = len(part.ids)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, NONE)
        for _, s, first in shared.value.scored(batches):
            cut = slice(first, first + s.shape[1])
            high[cut] = np.maximum(high[cut], s.max(axis=0, initial=NONE))
            low[cut] = np.minimum(low[cut], np.where(s == NONE, np.iinfo(np.int64).max, s).min(axis=0, initial=np.iinfo(np.int64).max))
        at = np.flatnonzero(high > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(low[at]), pa.array(high[at])],
                                         names=["q", "low", "high"])

    low, width, above = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for r in (rows.mapInArrow(bounds, "q int, low long, high long").groupBy("q")
              .agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()):  # one row a query of the block
        low[r.q], width[r.q] = r.low, r.high - r.low + 1
    while n and width.max() > 1:
        step = -(-width // bins)
        state = spark.sparkContext.broadcast((low.copy(), width.copy(), np.maximum(step, 1), above.copy()))

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, wide, st, _ = state.value
            count, higher = np.zeros((n, bins), dtype=np.int64), np.zeros(n, dtype=np.int64)
            for _, s, first in shared.value.scored(batches):
                cut = slice(first, first + s.shape[1])
                end = lo[cut] + wide[cut]
                higher[cut] += (s >= end).sum(axis=0)
                c, q = np.nonzero((s >= lo[cut]) & (s < end))  # NONE lies under every range
                cell = (first + q) * bins + (s[c, q] - lo[first + q]) // st[first + q]
                count += np.bincount(cell, minlength=n * bins).reshape(n, bins)
            down = count[:, ::-1].cumsum(axis=1)[:, ::-1] + higher[:, None]  # scores in this bin or higher
            q, at = np.nonzero((count > 0) & (down - count < k))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(count[q, at])], names=["q", "bin", "n"])

        sums = rows.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        start = spark.createDataFrame([(i, int(above[i])) for i in range(n)], "q int, above long")  # the block's queries
        hit = (sums.join(F.broadcast(start), "q").withColumn("upto", F.col("above") + F.sum("n").over(down))
               .groupBy("q").agg(F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))).alias("hit"),
                                 F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("last")))
        for r in hit.collect():  # one row a query of the block; without k candidates the lowest bin
            got = r.hit or r.last
            top = low[r.q] + width[r.q]
            low[r.q] += got.bin * step[r.q]
            width[r.q] = min(step[r.q], top - low[r.q])
            above[r.q] = got.above
        state.unpersist()
    last = spark.sparkContext.broadcast(low)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied: dict[int, list[int]] = {}
        ids = np.asarray(shared.value.ids, dtype=np.int64)
        for key, s, first in shared.value.scored(batches):
            value = last.value[first:first + s.shape[1]]
            c, q = np.nonzero(s > value)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + q]), pa.array(key[c]), pa.array(s[c, q])],
                                             names=["query_id", "vec_id", "score"])
            c, q = np.nonzero((s == value) & (s != NONE))
            order = np.lexsort((key[c], q))
            c, q = c[order], q[order]
            for run in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else ():
                i = int(first + q[run[0]])
                tied[i] = sorted(tied.get(i, []) + key[c[run[:k]]].tolist())[:k]
        flat = [(int(ids[i]), v, int(last.value[i])) for i, vs in tied.items() for v in vs]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)],
                                         names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.mapInArrow(survivors, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
