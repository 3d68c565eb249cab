"""Word shingles of whole texts as 64-bit hashes, vectorised over documents."""

from __future__ import annotations

import numpy as np

from .common import mix64

STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_T: dict = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _tables():
    if not _T:
        letters = np.random.default_rng(2).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        letters[65:91] = letters[97:123]  # A-Z count as a-z
        size = STEP + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.empty(size, np.uint64)
            p[0], have, step = 1, 1, base
            while have < size:
                take = min(have, size - have)
                np.multiply(p[:take], np.uint64(step), out=p[have : have + take])
                have, step = have + take, step * step & ((1 << 64) - 1)
            _T[name] = p
        _T["letters"] = letters
    return _T["letters"], _T["up"], _T["down"]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    first = off[:-1][off[:-1] < n]
    begin[first] = inside[first]
    last = off[1:] - 1
    last = last[last >= 0]
    stop[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased words."""
    letters, up, down = _tables()
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        lo = s[i]
        j = max(i + 1, int(np.searchsorted(e, lo + STEP, side="right")))
        hi = e[j - 1]
        if hi - lo > STEP:  # one word longer than the step
            h = np.uint64(0)
            for a in range(int(lo), int(hi), STEP):
                part = letters[data[a : min(a + STEP, hi)]]
                h = mix64(np.array([h ^ (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[i] = h
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(letters[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            a = s[i:j] - lo
            out[i:j] = (sums[e[i:j] - lo] - sums[a]) * down[a]
        i = j
    return mix64(out)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document in turn, offsets).

    Shingles are two words; a document of one word has that word alone.
    """
    n = len(off) - 1
    s, e, doc = word_bounds(data, off)
    h = word_hashes(data, s, e)
    pair = doc[1:] == doc[:-1]
    sh = mix64(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[1:] ^ np.uint64(0x165667B19E3779F9)))[pair] if len(h) > 1 else h[:0]
    sd = doc[:-1][pair] if len(h) > 1 else doc[:0]
    lone = np.bincount(doc, minlength=n)[doc] == 1
    sh, sd = np.concatenate([sh, h[lone]]), np.concatenate([sd, doc[lone]])
    o = np.argsort(sh)
    o = o[np.argsort(sd[o], kind="stable")]
    sh, sd = sh[o], sd[o]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    sh, sd = sh[new], sd[new]
    return sh, np.searchsorted(sd, np.arange(n + 1))
