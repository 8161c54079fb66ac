"""Words of a batch of texts as codes of its distinct words (Arrow), and rows of ids by code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every space: (code of each word, first word of each text and the end, distinct words)."""
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    words = parts.values.dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.offsets.to_numpy(), words.dictionary.to_pylist()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of texts without NULLs one after another, where each begins and the end)."""
    _, ends, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(ends, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def coded_pieces(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Pieces of UTF-8 bytes that begin at `begins` (the end last): (code of each, distinct pieces)."""
    pieces = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data))
    pieces = pieces.dictionary_encode()
    return pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()


def expanded(codes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids before each word and in total).

    Code c has ids[ends[c]:ends[c + 1]].
    """
    n = np.diff(ends)[codes]
    before = np.concatenate([[0], np.cumsum(n)])
    kind = np.int32 if max(before[-1], len(ids)) < 1 << 31 else np.int64
    place = np.repeat((ends[:-1][codes] - before[:-1]).astype(kind), n)
    place += np.arange(before[-1], dtype=kind)
    return ids[place], before
