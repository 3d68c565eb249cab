"""Plain single-process definitions that tests hold the operators against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def suffix_dedup(docs: dict[int, str | None], length: int = 50) -> dict[int, tuple]:
    least: dict[bytes, int] = {}
    for i in sorted(docs):
        t = (docs[i] or "").encode()
        for p in range(len(t) - length + 1):
            least.setdefault(t[p : p + length], i)
    out = {}
    for i, text in docs.items():
        t = (text or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([(words[0],)])


def near_dedup(docs: dict[int, str | None]) -> dict[int, tuple]:
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    ids = sorted(docs)
    for n, a in enumerate(ids):
        near = {b for x in sets[a] for b in by[x] if b > a}
        for b in near:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in docs}
