"""Vector code compression: product-quantiser codebooks by cover-tree Lloyd rounds.

Vectors of whole numbers are cut into parts; every part position has a codebook, refined by Lloyd
rounds. Each chunk of vectors gets one cover tree a part position, built once and written to the
shared folder: a node has a centre point, the radius that holds all its points, their count and
their sum, and its children are a net of the points at half that radius (the centre is its own
first child). A round sends the codebook entries down the trees level by level. For a point within
r of a centre, an entry farther from the centre than the nearest one by more than 2r cannot be its nearest
(triangle inequality); if a single entry is left, the whole subtree goes to it with its count and
sum. Only ambiguous nodes descend, and points that stay ambiguous are compared exactly, in
integers, ties to the lower index. Bounds are floating and pruning keeps a margin, so rounding can
only send a node further down.

A round gives the driver count and sum of every codebook entry, a fixed number of integers; the
codebook is broadcast (entries x dimensions integers). Equal points are one node, so a vector that
holds a third of all rows costs one comparison a chunk.

Vectors that take part: see `vectors.whole`; of other than the commonest length they are dropped.
Lengths that the parts do not divide are filled up with zeros, which changes no distance. The start
entries are the vectors of the smallest ids (missing ids last, equal ids by their components);
with fewer vectors than entries the codebook is that much smaller. Rows keep their own
code whether ids are equal or missing. No vector: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ship_package, written
from parley.llm.vectors import arrays, matrix, of_one_length, whole

MARGIN = 1e-6   # relative, on distances: far above rounding of float64


@dataclass(frozen=True)
class CodeParams:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    chunk: int = 512         # vectors a tree


@dataclass(frozen=True)
class Tree:
    """Nodes by level; `lo`, `hi` are a node's points in `order`, children are nodes first .. first + n - 1."""
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    n: np.ndarray
    radius: np.ndarray

    def packed(self) -> list[bytes]:
        return [getattr(self, f).astype("<f8" if f == "radius" else "<i4").tobytes() for f in FIELDS]

    @staticmethod
    def unpacked(values: list[bytes]) -> Tree:
        return Tree(*[np.frombuffer(v, dtype="<f8" if f == "radius" else "<i4") for f, v in zip(FIELDS, values)])


FIELDS = ("order", "lo", "hi", "first", "n", "radius")


def build(points: np.ndarray) -> Tree:
    """Cover tree of the rows of an integer matrix."""
    x = points.astype(np.float64)  # products under 2^53 are exact; larger ones only widen a radius by rounding
    order = np.arange(len(x))
    lo, hi, first, n, radius = [0], [len(x)], [0], [0], [0.0]
    at = 0
    while at < len(lo):
        own = order[lo[at]:hi[at]]
        far = np.sqrt(((x[own] - x[own[0]]) ** 2).sum(axis=1))
        radius[at] = float(far.max(initial=0.0)) * (1 + MARGIN)
        if radius[at] > 0:
            first[at], groups, left, reach = len(lo), [], own, far.max() / 2
            near = far <= reach
            while len(left):
                groups.append(left[near])
                left = left[~near]
                if len(left):
                    near = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1)) <= reach
            n[at] = len(groups)
            order[lo[at]:hi[at]] = np.concatenate(groups)
            ends = lo[at] + np.cumsum([0, *map(len, groups)])
            lo += ends[:-1].tolist()
            hi += ends[1:].tolist()
            first += [0] * len(groups)
            n += [0] * len(groups)
            radius += [0.0] * len(groups)
        at += 1
    return Tree(order, np.array(lo), np.array(hi), np.array(first), np.array(n), np.array(radius))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64 (Python integers where those do not reach)."""
    top = int(np.abs(a).max(initial=0)) + int(np.abs(b).max(initial=0))
    if top * top * a.shape[1] < 1 << 50:  # float64 products and sums are exact
        fa, fb = a.astype(np.float64), b.astype(np.float64)
        return ((fa * fa).sum(axis=1)[:, None] + (fb * fb).sum(axis=1)[None, :] - 2.0 * (fa @ fb.T)).astype(np.int64)
    if top * top * a.shape[1] < 1 << 62:
        return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)
    raise OverflowError("squared distances do not fit a long")


def assign(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Nearest entries by descent: (whole subtrees as (lo, hi, entry) in tree order, points compared
    one by one, their entries)."""
    whole_, level = [], np.array([0]) if len(points) else np.zeros(0, dtype=np.int64)
    single, entry = [], []
    while len(level):
        centre = tree.order[tree.lo[level]]
        d = squared(points[centre], codebook)
        best = d.argmin(axis=1)  # the lowest index among equals
        leaf = tree.n[level] == 0
        far = np.sqrt(d.astype(np.float64))
        reach = far[np.arange(len(level)), best] + 2 * tree.radius[level]
        alone = (far <= (reach * (1 + MARGIN) + MARGIN)[:, None]).sum(axis=1) == 1
        for i in np.flatnonzero(alone & ~leaf):
            whole_.append((int(tree.lo[level[i]]), int(tree.hi[level[i]]), int(best[i])))
        for i in np.flatnonzero(leaf):  # equal points: compared exactly as one
            single.append(level[i])
            entry.append(best[i])
        down = level[~alone & ~leaf]
        level = np.concatenate([np.arange(tree.first[v], tree.first[v] + tree.n[v]) for v in down]) if len(down) else down
    return whole_, np.array(single, dtype=np.int64), np.array(entry, dtype=np.int64)


def codes(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> np.ndarray:
    """Entry of every point."""
    out = np.empty(len(points), dtype=np.int64)
    subtrees, leaves, entry = assign(points, tree, codebook)
    for lo, hi, e in subtrees:
        out[tree.order[lo:hi]] = e
    for v, e in zip(leaves, entry):
        out[tree.order[tree.lo[v]:tree.hi[v]]] = e
    return out


def sums_of(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the points of every entry, from differences of the tree's running sums."""
    running = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points[tree.order], axis=0)])
    subtrees, leaves, entry = assign(points, tree, codebook)
    lo = np.array([s[0] for s in subtrees] + tree.lo[leaves].tolist(), dtype=np.int64)
    hi = np.array([s[1] for s in subtrees] + tree.hi[leaves].tolist(), dtype=np.int64)
    to = np.array([s[2] for s in subtrees] + entry.tolist(), dtype=np.int64)
    count, total = np.zeros(len(codebook), dtype=np.int64), np.zeros((len(codebook), points.shape[1]), dtype=np.int64)
    np.add.at(count, to, hi - lo)
    np.add.at(total, to, running[hi] - running[lo])
    return count, total


def planted(rows: DataFrame, d: int, p: CodeParams) -> DataFrame:
    """The rows in chunks with a tree a part: (ids, labels, x flat, trees), written once."""
    width = -(-d // p.parts)
    keep = [c for c in rows.columns if c != "x"]
    fields = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), p.chunk):
                part = b.slice(a, p.chunk)
                x = np.pad(matrix(part.column("x"), d), ((0, 0), (0, width * p.parts - d)))
                trees = [build(x[:, k * width:(k + 1) * width]).packed() for k in range(p.parts)]
                cols = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.reshape(-1)], pa.list_(pa.int64())),
                                                  pa.array([trees], pa.list_(pa.list_(pa.binary())))], names=[*keep, "x", "trees"])

    return written(rows.select(*keep, "x").mapInArrow(run, f"{fields}, x array<long>, trees array<array<binary>>"), "cover-trees")


def _chunks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, list[Tree]]]:
    for b in batches:
        for i in range(len(b)):
            x = b.column("x")[i].values.to_numpy().reshape(-1, width * parts)
            yield b, i, x, [Tree.unpacked(t) for t in b.column("trees")[i].as_py()]


def refined(chunks: DataFrame, books: np.ndarray, p: CodeParams) -> np.ndarray:
    """One round: codebooks (parts x entries x width) with every used entry moved to the floor of its mean."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((parts * entries, width + 1), dtype=np.int64)
        for _, _, x, trees in _chunks(batches, width, parts):
            for k in range(parts):
                n, s = sums_of(x[:, k * width:(k + 1) * width], trees[k], shared.value[k])
                got[k * entries:(k + 1) * entries, :width] += s
                got[k * entries:(k + 1) * entries, width] += n
        used = np.flatnonzero(got[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), arrays(got[used])], names=["entry", "v"])

    cells = (chunks.select("x", "trees").mapInArrow(run, "entry int, v array<long>").select("entry", F.posexplode("v").alias("j", "v"))
             .groupBy("entry", "j").agg(F.sum("v").alias("v")).collect())  # one number a cell of the codebooks
    total = np.zeros((parts * entries, width + 1), dtype=np.int64)
    for entry, j, v in cells:
        total[entry, j] = v
    shared.destroy()
    n = total[:, width:]
    flat = books.reshape(parts * entries, width)
    return np.where(n > 0, total[:, :width] // np.maximum(n, 1), flat).reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, p: CodeParams = CodeParams(), id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks (parts x entries x width)."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole(vector_col, p.scale).alias("x"))
    rows, d = of_one_length(written(rows.where("x IS NOT NULL"), "codes"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if d == 0:
        return spark.createDataFrame([], schema), np.zeros((p.parts, 0, 0), dtype=np.int64)
    width = -(-d // p.parts)
    start = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(p.entries).collect()]  # the first codebook
    start = np.pad(np.array(start, dtype=np.int64), ((0, 0), (0, width * p.parts - d)))
    books = start.reshape(len(start), p.parts, width).transpose(1, 0, 2).copy()
    chunks = planted(rows, d, p)
    for _ in range(p.rounds):
        books = refined(chunks, books, p)
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x, trees in _chunks(batches, width, p.parts):
            cut = [x[:, k * width:(k + 1) * width] for k in range(p.parts)]
            got = np.stack([codes(cut[k], trees[k], shared.value[k]) for k in range(p.parts)], axis=1)
            error = sum(((cut[k] - shared.value[k][got[:, k]]) ** 2).sum(axis=1) for k in range(p.parts))
            yield pa.RecordBatch.from_arrays([b.column("vec_id")[i].values, b.column("label")[i].values,
                                              pa.array(["".join(f"{c:02x}" for c in row) for row in got.tolist()], pa.string()),
                                              pa.array(error)], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """`label_error`: the error summed over rows of equal label, rows without one together."""
    of = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(of, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
