"""Token ids as Simple-8b words (numpy).

A block is a run of ids packed into 64-bit words: 4 bits of selector, 60 bits of equally wide
values, as many as fit. A value over 60 bits is escaped: selector 0, then the value in a word of
its own. Blocks hold up to BLOCK ids; `offsets` (first word of every block) lets a reader decode
any block alone, and decoding is vectorised by selector.
"""

from __future__ import annotations

import numpy as np

# fixed values of the format: (values per word, bits per value) by selector, from 1
WORDS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([1, *(c for c, _ in WORDS)])
BITS = np.array([0, *(b for _, b in WORDS)])
BLOCK = 1 << 16
WIDTH16 = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)
ESCAPE = np.uint64(1 << 60)
MASK = np.uint64((1 << 60) - 1)


def widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    out = WIDTH16[(v & np.uint64(0xFFFF)).astype(np.uint16)]
    top = int(v.max(initial=0))
    for k in (16, 32, 48):
        if top >> k:
            part = ((v >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.uint16)
            out = np.where(part > 0, WIDTH16[part] + np.uint8(k), out)
    return out


def _runs(good: np.ndarray, c: int) -> np.ndarray:
    """Where c values in a row are good (by doubling)."""
    have, r = 1, good
    while have < c and r.any():
        more = min(have, c - have)
        r = r[:len(r) - more] & r[more:]
        have += more
    return r if have == c else np.zeros(0, dtype=bool)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of one block; each takes as many of the next values as one selector holds."""
    v = np.asarray(ids, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = widths(v)
    choice = np.zeros(n, dtype=np.int8)  # 0: escape
    for s in range(len(WORDS), 0, -1):  # fewest values first, so that the largest count that fits stays
        c, b = WORDS[s - 1]
        if c <= n:
            fit = _runs(width <= b, c)
            choice[:len(fit)][fit] = s
    step = COUNT.astype(np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = choice[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(sel == 0)[:-1]])  # escapes take two words
    words = np.zeros(len(at) + int((sel == 0).sum()), dtype=np.uint64)
    for s in np.unique(sel):
        here, to = at[sel == s], place[sel == s]
        if s == 0:
            words[to + 1] = v[here]
            continue
        c, b = WORDS[s - 1]
        got = v[here[:, None] + np.arange(c)] << (np.arange(c) * b).astype(np.uint64)
        words[to] = np.bitwise_or.reduce(got, axis=1) | (np.uint64(s) << np.uint64(60))
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """Values of one block."""
    w = np.asarray(words, dtype=np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int64)
    at = np.arange(len(w))
    if (sel == 0).any() or (len(w) and sel.max() > len(WORDS)):  # escapes: the word after one is no selector
        keep, i, s = [], 0, sel.tolist()
        while i < len(s):
            keep.append(i)
            i += 2 if s[i] == 0 else 1
        at = np.array(keep)
        sel = sel[at]
    ends = np.cumsum(COUNT[sel]) if len(at) else np.zeros(0, dtype=int)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(sel):
        here = sel == s
        c, b = (1, 64) if s == 0 else WORDS[s - 1]
        start = ends[here] - c
        if s == 0:
            out[start] = w[at[here] + 1]
        else:
            got = (w[at[here]] & MASK)[:, None] >> (np.arange(c) * b).astype(np.uint64)
            out[start[:, None] + np.arange(c)] = got & np.uint64((1 << b) - 1)
    return out


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of any number of ids."""
    parts = [pack(ids[a:a + block]) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), offsets


def unpack_blocks(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [unpack(words[a:b]) for a, b in zip(offsets, offsets[1:])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
