"""Quality classifier: a byte-level convolutional network in numpy.

Each filter looks at `width` bytes at every position of the text (a weight per place and byte
value). Its highest value in a chunk is max-pooled; chunks of 2 * `stride` bytes start every
`stride` bytes and so overlap by half and cover the whole text. A chunk's pooled values give its
logit, the mean over the text's chunks its probability. Pooling works on half chunks, so every
byte is convolved once, and in pieces of bounded size whatever the text's length.

Training (Adam on the driver) reads a bounded sample: about `per_class` labelled ids of each class,
`chunks` chunks of each spread evenly over its text. NULL and empty texts read as one zero byte.
Without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import labelled_sample, one_row_each, ship_package, texts_of

PIECE = 1 << 17  # bytes convolved at a time


@dataclass(frozen=True)
class NetParams:
    width: int = 5
    filters: int = 16
    stride: int = 512
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-5
    per_class: int = 1000   # bounds of the training sample
    chunks: int = 12
    mod: int = 5            # ids whose crc32 has remainder `held` modulo `mod` are never learned from
    held: int = 0
    seed: int = 5


@dataclass
class Net:
    filters: np.ndarray  # width x 256 x filters
    bias: np.ndarray
    out: np.ndarray
    base: float
    stride: int

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """Filter values at every position that has `width` bytes."""
        n = len(x) - len(self.filters) + 1
        y = self.filters[0][x[:n]]
        for k in range(1, len(self.filters)):
            y += self.filters[k][x[k:k + n]]
        return y

    def half_chunks(self, raw: bytes) -> np.ndarray:
        """Highest filter values of every half chunk."""
        pad, out, n = len(self.filters) - 1, [], max(1, len(raw))
        x = np.frombuffer(raw + b"\0" * (pad + n - len(raw)), dtype=np.uint8)
        step = max(1, PIECE // self.stride) * self.stride
        for a in range(0, n, step):
            y = self.convolved(x[a:min(a + step, n) + pad])
            out.append(np.maximum.reduceat(y, np.arange(0, len(y), self.stride), axis=0))
        return np.concatenate(out)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base

    def score(self, texts: list[str]) -> np.ndarray:
        logit = np.empty(len(texts))
        for i, t in enumerate(texts):
            half = self.half_chunks(t.encode("utf-8", "surrogatepass"))
            chunk = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
            logit[i] = self.logits(chunk).mean()
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def spread(raw: bytes, stride: int, most: int) -> list[bytes]:
    """Up to `most` of a text's chunks, evenly spread."""
    starts = range(0, max(1, len(raw) - stride), stride)
    picked = sorted({round(i) for i in np.linspace(0, len(starts) - 1, min(most, len(starts)))})
    return [raw[starts[i]:starts[i] + 2 * stride] for i in picked]


def fit(examples: list[tuple[list[bytes], int]], p: NetParams) -> Net:
    rng = np.random.default_rng(p.seed)
    net = Net(rng.normal(0, 0.2, (p.width, 256, p.filters)).astype(np.float32), np.zeros(p.filters, np.float32),
              rng.normal(0, 0.3, p.filters).astype(np.float32), 0.0, p.stride)
    if len({y for _, y in examples}) < 2:
        net.out[:] = 0
        return net
    size = p.filters * p.width * 256
    theta = np.concatenate([net.filters.ravel(), net.bias, net.out, [0.0]])
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    place = np.arange(p.width)
    for _ in range(p.epochs):
        order = rng.permutation(len(examples))
        for a in range(0, len(order), p.batch):
            net.filters = theta[:size].reshape(p.width, 256, p.filters).astype(np.float32)
            net.bias, net.out, net.base = theta[size:size + p.filters], theta[size + p.filters:-1], theta[-1]
            grad = p.decay * theta
            for i in order[a:a + p.batch]:
                chunks, y = examples[i]
                pooled, windows = [], []
                for c in chunks:
                    x = np.frombuffer(c + b"\0" * (p.width - 1 + (not c)), dtype=np.uint8)
                    conv = net.convolved(x)
                    best = conv.argmax(axis=0)
                    pooled.append(conv[best, np.arange(p.filters)])
                    windows.append(x[best[:, None] + place])  # filters x width bytes
                raw = np.array(pooled) + net.bias
                act = np.maximum(raw, 0)
                err = (1.0 / (1.0 + np.exp(-np.clip((act @ net.out).mean() + net.base, -40, 40))) - y) / p.batch
                grad[-1] += err
                grad[size + p.filters:-1] += err * act.mean(axis=0)
                back = err / len(chunks) * net.out * (raw > 0)
                grad[size:size + p.filters] += back.sum(axis=0)
                cell = (place * 256 + np.array(windows)) * p.filters + np.arange(p.filters)[:, None]
                grad[:size] += np.bincount(cell.ravel(), np.repeat(back.ravel(), p.width), size)
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            theta = theta - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Net(theta[:size].reshape(p.width, 256, p.filters).astype(np.float32),
               theta[size:size + p.filters].astype(np.float32), theta[size + p.filters:-1].astype(np.float32),
               float(theta[-1]), p.stride)


def train(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams(), label: str = "quality") -> Net:
    ship_package(docs.sparkSession)
    ids = labelled_sample(labels, label, p.mod, p.held, p.per_class, p.seed)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(ids), "doc_id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = [spread(t.encode("utf-8", "surrogatepass"), p.stride, p.chunks) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("text_hash"), pa.array(found, pa.list_(pa.binary()))],
                                             names=["doc_id", "y", "text_hash", "chunks"])

    # one row of each id reaches the driver, however often an id is repeated
    got = one_row_each(rows.mapInArrow(run, "doc_id long, y int, text_hash long, chunks array<binary>"), "y", "chunks").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return fit(list(zip(got.column("chunks").to_pylist(), got.column("y").to_pylist())), p)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, in one pass without a shuffle."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(texts_of(b.column(1))))],
                                             names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
