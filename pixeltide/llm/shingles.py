"""Word shingles of a unit of texts, as flat arrays of 64-bit hashes.

Words are runs of characters other than white space (bytes 0x20 and 0x09-0x0D),
with A-Z lower-cased.  Everything is computed on the unit's byte buffer at once.
"""

from __future__ import annotations

import numpy as np

from .exchange import Unit

_RANDOM = np.random.default_rng(7)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z hash as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_STEP = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(unit: Unit, slice_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word, in order of place: first byte, end, hash and document index."""
    buf = unit.buf
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    ink = ~_BLANK[buf]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    inner = unit.starts[(unit.starts > 0) & (unit.starts < n)]
    head[inner] |= ink[inner]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    tail[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    longest = int((end - start).max(initial=1))
    power = np.ones(longest, np.uint64)
    np.multiply.accumulate(np.full(longest - 1, _BASE, np.uint64), out=power[1:]) if longest > 1 else None
    out = np.empty(len(start), np.uint64)
    # words are hashed some at a time, so that 64-bit copies of the bytes stay small
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + slice_bytes, side="right")))
        a, b = start[at:stop], end[at:stop]
        size = b - a
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        which = place + np.repeat(a, size)
        out[at:stop] = np.add.reduceat(_BYTES[buf[which]] * power[place], np.cumsum(size) - size)
        at = stop
    # words are in order of their documents
    first = np.searchsorted(start, unit.starts)
    return start, end, mix(out), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))


def shingles(word: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size``-word shingle and its document; a shorter document's words are one shingle."""
    n = len(word)
    if not n:
        return word, doc
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    begin = np.flatnonzero(first)
    count = np.diff(np.concatenate([begin, [n]]))
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= size:
        full = sum(word[i : n - size + 1 + i] * _STEP[i] for i in range(size))
        at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    short = np.flatnonzero(count < size)
    parts = np.zeros(len(short), np.uint64)
    for i in range(size - 1):
        has = count[short] > i
        parts[has] += word[begin[short[has]] + i] * _STEP[i]
    parts = mix(parts, 1) ^ mix(count[short].astype(np.uint64), 2)
    hashes = np.concatenate([mix(full[at]), parts])
    docs = np.concatenate([doc[at], doc[begin[short]]])
    order = np.argsort(docs, kind="stable")
    return hashes[order], docs[order]


def sets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, sorted by (document, hash)."""
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    h, d = hashes[order], doc[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[keep], d[keep]
    return h, d
