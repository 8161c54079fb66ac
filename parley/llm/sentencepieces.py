"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model is a BPE model with byte fallback (identity normalisation, dummy prefix). A sequence of
pieces is the BPE encoding of its text exactly when every neighbouring pair is the encoding of its
own text, so encoding is a best path with weight 0 for an allowed pair and minus infinity for any
other: a max-plus recurrence over positions whose state is the last piece.

Texts of up to `chunk` characters are one chunk. Longer ones are cut into chunks of that many
characters at any place (in the middle of a word too), dealt out over the cluster:
  1. each chunk yields its transfer matrix: for every piece that may straddle or end at its left
     border, the pieces that can straddle or end at its right border;
  2. the matrices of a document are combined associatively in a tree; walking back down the tree
     fixes the state at every border;
  3. each chunk is backtraced on its own between its two states, and yields the pieces that begin in it.
No piece holds a space mark after another character, so at a word start the state is always the
same; inside a chunk the recurrence runs over its first and last partial words (over all of it when
it has no word start) and whole words come from the library's encoder.

NULL and empty texts have no ids. Decoding gives back the text, with U+2581 as a space, as the
format has it. Repeated rows and rows without an id stay apart (row id).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import RID, ship_package, slices, texts_of, with_row_id, written
from parley.llm.words import coded, expanded

MARK = "▁"
CHUNK = 1 << 15
CACHE = 100_000  # pairs of pieces whose weight is remembered
SLICE = 1 << 22  # characters encoded at a time
NO_IDS = np.zeros(0, dtype=np.int32)
START = ("", 0)  # state at the left end of a document: no piece yet
WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.rank = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        if sp.unk_id() in self.byte or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("needs a model with byte fallback whose pieces hold no space mark inside")
        self.bytes = [b""] * size
        for p, i in self.id.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.fits: dict[tuple[str, str], bool] = {}

    # whole texts and words ---------------------------------------------------------------------
    def of(self, piece: str) -> np.ndarray:
        i = self.id.get(piece)
        return np.asarray([i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "replace")], dtype=np.int32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the mark followed by each word, and where each word's begin."""
        found = [x if w else [self.id[MARK]] for w, x in zip(words, self.sp.encode(words, num_threads=1))]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.fromiter((i for x in found for i in x), dtype=np.int32, count=ends[-1]), ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text: a batch's distinct words are encoded once."""
        out = [None] * len(texts)
        for i, t in enumerate(texts):
            if not t:
                out[i] = NO_IDS
            elif "  " in t or t[0] == " " or t[-1] == " " or MARK in t:  # runs of marks: each goes to the word after it
                out[i] = self.words([w[1:].replace(MARK, " ") for w in WORD.findall(MARK + t.replace(" ", MARK))])[0]
        rest = [i for i in range(len(texts)) if out[i] is None]
        codes, first, known = coded([texts[i] for i in rest])
        ids, before = expanded(codes, *self.words(known))
        for i, a, b in zip(rest, before[first[:-1]], before[first[1:]]):
            out[i] = ids[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        parts = [b"".join(map(self.bytes.__getitem__, ids[a:a + SLICE].tolist())) for a in range(0, len(ids), SLICE)]
        return b"".join(parts).decode("utf-8", "replace")[1:]

    # the recurrence ----------------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-ranked neighbours merge first, the leftmost among equals."""
        parts = list(text)
        while True:
            best = max(((self.rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                       default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def allowed(self, a: str, b: str) -> bool:
        """Weight of the pair: True is 0, False minus infinity; with a empty, of b alone."""
        got = self.fits.get((a, b))
        if got is None:
            got = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.fits) >= CACHE:
                self.fits.clear()
            self.fits[a, b] = got
        return got

    def starting(self, text: str, i: int) -> list[str]:
        return [text[i:i + n] for n in range(1, min(self.longest, len(text) - i) + 1)
                if (n == 1 or text[i:i + n] in self.rank) and self.allowed("", text[i:i + n])]

    def states(self, text: str, at: int) -> list[tuple[str, int]]:
        """Pieces that begin before `at` and end there or later, with how far they reach over."""
        return [(p, i + len(p) - at) for i in range(max(0, at - self.longest), at)
                for p in self.starting(text, i) if i + len(p) >= at]

    def paths(self, text: str, a: int, b: int, entries: list[tuple[str, int]]) -> dict[int, dict[str, dict]]:
        """Forward recurrence from `a`: end position -> last piece -> entry -> piece before it.

        Runs until every piece that begins before b has been placed."""
        at: dict[int, dict[str, dict]] = {}
        for e in entries:
            at.setdefault(a + e[1], {}).setdefault(e[0], {})[e] = None
        for i in range(a, b):
            here = at.get(i)
            if here:
                for u in self.starting(text, i):
                    for t, froms in here.items():
                        if self.allowed(t, u):
                            to = at.setdefault(i + len(u), {}).setdefault(u, {})
                            for e in froms:
                                to.setdefault(e, t)
        return at

    @staticmethod
    def _back(at: dict, a: int, end: int, piece: str, entry: tuple[str, int]) -> list[str]:
        """Pieces of the path from `entry` to `piece` ending at `end`, the entry's own left out."""
        out = []
        while (piece, end - a) != entry or at[end][piece][entry] is not None:
            out.append(piece)
            piece, end = at[end][piece][entry], end - len(piece)
        return out[::-1]

    # chunks: `text` with `left` characters of context before and some after ----------------------
    def _borders(self, text: str, left: int, n: int) -> tuple[int | None, int | None]:
        """First and last word start in the chunk; None where there is none."""
        starts = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text[max(0, left - 1):left + n])]
        starts = [s + max(0, left - 1) for s in starts]
        if left == 0:
            starts = [0, *starts]
        return (starts[0], starts[-1]) if starts else (None, None)

    def transfer(self, text: str, left: int, n: int) -> dict[tuple, list[tuple]]:
        """The matrix as entry -> exits (weight 0; any other is minus infinity)."""
        entries = self.states(text, left) if left else [START]
        first, last = self._borders(text, left, n)
        end = left + n
        if first is None:
            at = self.paths(text, left, end, entries)
            out: dict[tuple, list[tuple]] = {}
            for stop in sorted(k for k in at if k >= end):
                for p, froms in at[stop].items():
                    if stop - len(p) < end:
                        for e in froms:
                            out.setdefault(e, []).append((p, stop - end))
            return out
        head = self.paths(text, left, first, entries)
        ok = [START] if left == 0 else [e for e in entries if any(e in f for f in head.get(first, {}).values())]
        tail = self.paths(text, last, end, [START])
        exits = [(p, stop - end) for stop in sorted(k for k in tail if k >= end) for p in tail[stop] if stop - len(p) < end]
        return {e: exits for e in ok}

    def backtrace(self, text: str, left: int, n: int, entry: tuple, leave: tuple) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, given the states at its two borders."""
        first, last = self._borders(text, left, n)
        end = left + n
        stop = end + leave[1]
        if first is None:
            at = self.paths(text, left, end, [entry])
            return np.concatenate([NO_IDS, *map(self.of, self._back(at, left, stop, leave[0], entry))])
        out = [NO_IDS]
        if left:
            at = self.paths(text, left, first, [entry])
            piece = next(p for p, f in at[first].items() if entry in f)
            out += map(self.of, self._back(at, left, first, piece, entry))
        out.append(self.words([w[1:].replace(MARK, " ") for w in WORD.findall(text[first:last])])[0])
        at = self.paths(text, last, end, [START])
        return np.concatenate(out + [self.of(p) for p in self._back(at, last, stop, leave[0], START)])


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two sparse matrices of zeros."""
    return {e: sorted({x for m in mids for x in b.get(m, ())}) for e, mids in a.items()}


def fix_borders(matrices: list[dict]) -> list[tuple[tuple, tuple]]:
    """(entry, exit) of every chunk: products up a tree, states down again."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([combine(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    last = [x for x in levels[-1][0][START] if x[1] == 0]
    states = [(START, last[0])]
    for m in levels[-2::-1]:
        below = []
        for k, (e, x) in enumerate(states):
            if 2 * k + 1 < len(m):
                mid = next(s for s in m[2 * k][e] if x in m[2 * k + 1].get(s, ()))
                below += [(e, mid), (mid, x)]
            else:
                below.append((e, x))
        states = below
    return states


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Once per worker process."""
    return Pieces(path)


def _list_of(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([NO_IDS, *ids])))


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row id, doc_id, ids array<int>) of every row; `model` is a path that every executor can read."""
    ship_package(docs.sparkSession)
    rows = with_row_id(docs).select(RID, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk  # with the dummy prefix: more than one chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = texts_of(b.column(2))
            for a, z in slices([len(t) for t in texts], SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a),
                                                  _list_of(p.encode(texts[a:z]))], names=[RID, "doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = pieces(model).longest
        for b in batches:
            for rid, key, text in zip(*(c.to_pylist() for c in b.columns)):
                text = MARK + text.replace(" ", MARK)
                for k, a in enumerate(range(0, len(text), chunk)):
                    left = min(a, margin + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], kind) for x, kind in (
                            (rid, pa.int64()), (key, b.column(1).type), (k, pa.int32()), (left, pa.int32()),
                            (min(chunk, len(text) - a), pa.int32()), (text[a - left:a + chunk + margin], pa.string()))],
                        names=[RID, "doc_id", "k", "left", "n", "part"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            got = [json.dumps(list(p.transfer(t, a, n).items()))
                   for t, a, n in zip(*(b.column(c).to_pylist() for c in ("part", "left", "n")))]
            yield pa.RecordBatch.from_arrays([b.column(RID), b.column("k"), pa.array(got)], names=[RID, "k", "matrix"])

    def borders(group: pa.Table) -> pa.Table:
        # one document's matrices: a row holds at most 2 GB of text, so at most some 10^5 chunks
        group = group.sort_by("k")
        read = [{tuple(e): [tuple(x) for x in xs] for e, xs in json.loads(m)} for m in group.column("matrix").to_pylist()]
        found = fix_borders(read)
        return pa.table({RID: group.column(RID), "k": group.column("k"),
                         "entry": pa.array([json.dumps(e) for e, _ in found]), "leave": pa.array([json.dumps(x) for _, x in found])})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            ids = [p.backtrace(t, a, n, tuple(json.loads(e)), tuple(json.loads(x)))
                   for t, a, n, e, x in zip(*(b.column(c).to_pylist() for c in ("part", "left", "n", "entry", "leave")))]
            yield pa.RecordBatch.from_arrays([b.column(RID), b.column("doc_id"), b.column("k"), _list_of(ids)],
                                             names=[RID, "doc_id", "k", "ids"])

    short = rows.where(~long).mapInArrow(whole, f"{RID} long, doc_id {kind}, ids array<int>")
    # written once: the row ids depend on the file splits, and two later reads meet on them
    parts = written(rows.where(long).mapInArrow(cut, f"{RID} long, doc_id {kind}, k int, left int, n int, part string")
                    .repartition(RID, "k"), "parts")
    states = (parts.mapInArrow(matrix, f"{RID} long, k int, matrix string")
              .groupBy(RID).applyInArrow(borders, f"{RID} long, k int, entry string, leave string"))
    traced = parts.join(states, [RID, "k"]).mapInArrow(trace, f"{RID} long, doc_id {kind}, k int, ids array<int>")
    long_ids = (traced.groupBy(RID).agg(F.first("doc_id").alias("doc_id"),
                                        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
                .select(RID, "doc_id", F.flatten("parts.ids").alias("ids")))
    return short.unionByName(long_ids)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with a column `ids` -> the same rows with its text `decoded` in place of it."""
    ship_package(rows.sparkSession)
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            ids = b.column(at)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            for a, z in slices(np.diff(ends).tolist(), SLICE):
                text = pa.array([p.decode(flat[i:j]) for i, j in zip(ends[a:z], ends[a + 1:z + 1])], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for i, c in enumerate(b.columns) if i != at), text],
                                                 names=[*(n for n in b.schema.names if n != "ids"), "decoded"])

    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(run, f"{keep}, decoded string")
