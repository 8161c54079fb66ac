"""Token-ID output: documents in ascending id order as Simple-8b words, written and read back.

Texts are range-partitioned by doc_id and sorted, encoded in that order, packed and written: one row
per run of documents with its first position, the Simple-8b words and the offsets of their blocks
("binary" columns of a Parquet container, so that any store that Spark writes to will do).
Positions count inside a part; the parts' totals (one row a part) give the global start.

The tokenizer's pre-tokens never cross a space or newline that stands next to something else, nor go
from a letter to a stop, so a batch is cut there, its distinct words are encoded once, many to a
call, and the ids are laid out by word. The cuts are found in the batch's UTF-8 bytes; a word is a
piece of them with the space or newline before it. A text in which a space or newline has white
space on both sides, or a stop follows a space, is encoded whole.

NULL texts read as empty; every document ends with `end_id`. Documents without an id come first,
equal ids stay apart, ordered by text checksum and row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import RID, scratch_path, ship_package, slices, with_row_id
from parley.llm.simple8b import pack_blocks, unpack_blocks
from parley.llm.words import coded_pieces, expanded, text_bytes

END_ID = 2
SLICE = 3 << 22  # bytes encoded at a time
JOINED = 4096  # words in a call
RUN_IDS = 1 << 16  # ids of a written row; a longer document has a row of its own
CACHE = 250_000  # words remembered by a worker, the first ones it meets
BLANKS = [chr(c).encode() for c in range(1 << 16) if chr(c).isspace()]
BLANK_ENDS, BLANK_BEGINS = (np.isin(np.arange(256), [b[i] for b in BLANKS]) for i in (-1, 0))  # bytes that white space may end or begin with
INNER_SPACE = re.compile(r"\s[ \n](?:\s|\Z)| [.,]")  # texts that the cuts below would not suit


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        size = self.tok.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)])  # a character stands for a byte

    def fresh(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin."""
        found = list(map(self.known.get, surfaces))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.strung([surfaces[i] for i in new])):
            found[i] = ids
            if len(self.known) < CACHE:
                self.known[surfaces[i]] = ids
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64) // 4])
        return np.frombuffer(b"".join(found), dtype="<u4"), ends

    def strung(self, surfaces: list[str]) -> list[bytes]:
        """Ids (uint32, little-endian) of each word. Words with a space or newline only in front are
        encoded strung together; their own lengths in bytes tell the ids apart."""
        out: list[bytes] = [b""] * len(surfaces)
        clean = [i for i, s in enumerate(surfaces) if s[0] in " \n" and s.split() == [s[1:]]]
        for a in range(0, len(clean), JOINED):
            part = clean[a:a + JOINED]
            ids = self.fresh(["".join([surfaces[i] for i in part])])[0]
            ends = np.cumsum([len(surfaces[i].encode()) for i in part])
            cut = (4 * (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1)).tolist()
            raw = ids.astype("<u4").tobytes()
            for i, x, z in zip(part, [0, *cut], cut):
                out[i] = raw[x:z]
        rest = sorted(set(range(len(surfaces))).difference(clean))
        for i, ids in zip(rest, self.fresh([surfaces[i] for i in rest])):
            out[i] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        data, at = text_bytes(texts)
        begins, odd = cuts(data, at)
        whole = [i for i in odd.tolist() if INNER_SPACE.search(texts[i].as_py())]
        codes, known = coded_pieces(data, begins)
        first = np.searchsorted(begins, at)
        if whole:  # their words are not asked for
            asked = np.ones(len(codes), dtype=bool)
            for i in whole:
                asked[first[i]:first[i + 1]] = False
            used, codes[asked] = np.unique(codes[asked], return_inverse=True)
            codes[~asked] = len(used)
            known = [known[c] for c in used.tolist()]
        ids, ends = self.words(known)
        ids, before = expanded(codes, ids, np.concatenate([ends, ends[-1:]]))
        out = [ids[a:b] for a, b in zip(before[first[:-1]].tolist(), before[first[1:]].tolist())]
        for i, own in zip(whole, self.fresh([texts[i].as_py() for i in whole])):
            out[i] = own
        return out


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of texts that begin at `at` (their end last), and the texts that may hold an
    INNER_SPACE: one byte next to the gap is looked at here."""
    gap, stop = (data == 32) | (data == 10), (data == 46) | (data == 44)
    begins = gap.copy()
    letter = ((data[:-1] | 32) >= 97) & ((data[:-1] | 32) <= 122)
    begins[1:] |= stop[1:] & letter
    begins = np.append(begins, False)
    begins[at] = True
    begins[-1] = True
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    before, after, then_stop = np.empty(len(data), bool), np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1], then_stop[:-1] = BLANK_ENDS[data[:-1]], BLANK_BEGINS[data[1:]], stop[1:]
    before[first], after[last], then_stop[last] = False, True, False
    odd = np.flatnonzero(gap & ((before & after) | (then_stop & (data == 32))))
    return np.flatnonzero(begins), np.unique(np.searchsorted(at, odd, side="right") - 1)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Once per worker process."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """`tokenizer` is a file that every executor can read."""
    ship_package(docs.sparkSession)
    rows = (with_row_id(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0))
                                     .alias("crc"), RID, F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype=np.uint32)
        part, at, held, count = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            texts, keys = b.column(1).fill_null(""), b.column(0).to_pylist()
            for a, z in slices(pc.binary_length(texts).to_pylist(), SLICE):
                for key, ids in zip(keys[a:z], enc.encode(texts.slice(a, z - a))):
                    if held and count + len(ids) >= RUN_IDS:
                        yield run(part, at, held, b.column(0).type)
                        at, held, count = at + count, [], 0
                    held.append((key, np.concatenate([ids, end])))
                    count += len(ids) + 1
        if held:
            yield run(part, at, held, b.column(0).type)

    (rows.repartitionByRange("doc_id", "crc", RID).sortWithinPartitions("doc_id", "crc", RID).select("doc_id", "text")
     .mapInArrow(lay_out, f"part int, at long, ids long, doc_id array<{kind}>, n array<long>, words binary, offsets binary")
     .write.parquet(path))


def run(part: int, at: int, docs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """One row of the container: the ids of documents in a row."""
    ids = np.concatenate([i for _, i in docs])
    words, offsets = pack_blocks(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()),
         pa.array([[k for k, _ in docs]], pa.list_(kind)), pa.array([[len(i) for _, i in docs]], pa.list_(pa.int64())),
         pa.array([words.astype("<u8").tobytes()]), pa.array([offsets.astype("<i8").tobytes()])],
        names=["part", "at", "ids", "doc_id", "n", "words", "offsets"])


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, uint32 little-endian) of every document in the files."""
    ship_package(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_id"].dataType.elementType.simpleString()
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect():  # one row a part
        base[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast(base)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, at, keys, sizes = (b.column(c)[i].as_py() for c in ("part", "at", "doc_id", "n"))
                ids = unpack_blocks(np.frombuffer(b.column("words")[i].as_py(), "<u8"),
                                    np.frombuffer(b.column("offsets")[i].as_py(), "<i8")).astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, b.column("doc_id").type.value_type), pa.array(shared.value[part] + at + ends - sizes),
                     pa.array(sizes, pa.int64()), pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, sizes)])],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")
