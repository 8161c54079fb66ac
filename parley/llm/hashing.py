"""Vectorised word hashes and hashed n-gram features of a batch of texts (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 22  # bytes hashed at a time; a single word longer than this is cut there
_POW = np.empty(4096, dtype=np.uint64)
_POW[0] = 1
for _i in range(1, 4096):
    _POW[_i] = np.uint64((int(_POW[_i - 1]) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'")] = True
_WORD[128:] = True  # bytes of letters beyond ASCII
_A, _B, _C, _D = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a UTF-8 buffer, ASCII case folded."""
    raw = np.frombuffer(buf, dtype=np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(raw):
        b = min(a + WINDOW, len(raw))
        if b < len(raw):
            cut = b
            while cut > a and _WORD[raw[cut - 1]]:
                cut -= 1
            b = cut if cut > a else b
        part = raw[a:b]
        is_word = _WORD[part]
        at = np.flatnonzero(is_word)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # in `at`: where a word begins
            rel = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            terms = (_LOWER[part[at]].astype(np.uint64) + np.uint64(1)) * _POW[rel & 4095]
            starts.append(at[first] + a)
            hashes.append(np.add.reduceat(terms, first))
        a = b
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), mix(np.concatenate(hashes))


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature index) of every word, bigram and skip-gram (one word between)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    start, h = word_hashes(b"\n".join(parts) + b"\n")
    doc = np.searchsorted(ends, start, side="right")
    both, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = mix(h[:-1] * _A + h[1:] * _B)[both]
    gap = mix(h[:-2] * _C + h[2:] * _D)[skip]
    index = np.concatenate([h, two, gap]) >> np.uint64(64 - bits)
    return np.concatenate([doc, doc[:-1][both], doc[:-2][skip]]), index.astype(np.int64)


def batches(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` characters."""
    from parley.llm.common import slices

    return slices([len(t) for t in texts], most)
