"""Suffix-array dedup by bucket-pointer refinement.

A byte goes if it lies in an L-byte string (L = 50) that also starts in a
document with a smaller id.  Every string of L bytes is *owned* by the smallest
hashed k-gram in it (a minimizer), so equal strings meet at equal owners:

1. Map: find the owners ("anchors") and, for each, the run of strings it owns.
   Of equal runs in one task only the smallest document's is shipped; the other
   documents' runs are known to go.  Hot passages thus shuffle one record a
   task.
2. Reduce, by anchor hash: equal runs in later documents go whole.  Where an
   anchor has several different runs (the borders of repeats), their contexts
   are asked for.
3. The contexts are cut out of the texts and form a sparse text; its suffixes
   are bucketed by q-grams and refined by the bucket pointers of later offsets
   (8, 16, 32, then 18 more: 50 bytes).  A string goes if its final bucket
   holds a smaller document.
4. The cuts join the texts.

The border of a passage that a third of all documents share is an anchor with
a different run in each of them, and one word again and again is one run over
and over.  Such hot anchors (over ``HOT`` runs) take
another way from where they are noticed: a task that sees one spreads its runs
by their own hashes and only leaves a mark at the anchor's place; their strings
are then compared one by one by 128-bit fingerprints, spread by fingerprint,
after each task has kept the smallest document of each.  No task ever gets all
runs of a hot anchor.

Nulls: a null text is empty; a null id ranks after every other id.  Rows that
share an id never remove each other's bytes.  Texts under L bytes stay whole.
An empty table gives an empty result.  Other columns of the input pass
through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, fan_out, join_packed, lean, materialize, mix64, pack, runs, ship, table, text_buffers, text_slices, trim, unpack

L_BYTES = 50
K_GRAM = 20
CHUNK = 1 << 20
SLICE = 8 << 20
FLUSH = 600_000
#: an anchor with more runs left than this is hot: its strings are compared one by one
HOT = 256
#: contexts of one reduce task are refined in so many separate ranges of anchor hashes
FINE = 8
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have, step = 1, 1, base
    while have < n:
        take = min(have, n - have)
        np.multiply(out[:take], np.uint64(step), out=out[have : have + take])
        have, step = have + take, step * step & _MASK64
    return out


_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        letters = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = CHUNK + 1024
        _TABLES["t"] = letters, _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    return _TABLES["t"]


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while m * 2 <= w:
        a = np.minimum(a[:-m], a[m:])
        m *= 2
    return np.minimum(a[: -(w - m)], a[w - m :]) if m < w else a


def _segment_anchors(d: np.ndarray, lo: np.ndarray, first: int, skip: int, length: int, k: int):
    """Anchors of consecutive documents (or of one piece of a document)."""
    letters, up, down = _tables()
    n = len(d)
    if n < length:
        return None
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters[d] * up[:n], out=sums[1:])
    h = mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])
    keys = (h & np.uint64(_MASK64 ^ 0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    owner = (_window_min(keys, length - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.arange(len(owner), dtype=np.int64)
    doc = np.repeat(np.arange(len(lo) - 1), np.diff(lo))[: len(owner)]
    good = at + length <= lo[doc + 1]
    at, owner, doc = at[good], owner[good], doc[good]
    if len(at) == 0:
        return None
    new = np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]
    starts = np.flatnonzero(new)
    count = np.diff(np.r_[starts, len(at)])
    p, a, doc = at[starts], owner[starts], doc[starts]
    inner = (a - p).astype(np.uint64)
    whole = (sums[p + count - 1 + length] - sums[p]) * down[p]
    v = mix64(whole + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + inner * np.uint64(0x9FB21C651E98DF25))
    return h[a], v, (doc + first).astype(np.uint32), (p - lo[doc] + skip).astype(np.uint32), count.astype(np.uint8)


def anchors(data: np.ndarray, off: np.ndarray, length: int = L_BYTES, k: int = K_GRAM):
    """Columns (anchor hash, run hash, document number, run start, run strings)."""
    parts, i, n = [], 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1
        if j > i:
            parts.append(_segment_anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], i, 0, length, k))
            i = j
            continue
        s, e, skip = off[i], off[i + 1], 0
        while s + skip < e:  # pieces of a long text overlap by length - 1
            stop = min(e, s + skip + CHUNK)
            parts.append(_segment_anchors(data[s + skip : stop], np.array([0, stop - s - skip]), i, skip, length, k))
            if stop == e:
                break
            skip += CHUNK - (length - 1)
        i += 1
    parts = [p for p in parts if p is not None]
    if not parts:
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint32, np.uint32, np.uint8)]
    return [np.concatenate(c) for c in zip(*parts)]


def _order(h: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by (h, v, doc); only ties of h are sorted further."""
    o = np.argsort(h)
    hs = h[o]
    same = hs[1:] == hs[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(tied):
        sub = o[tied]
        o[tied] = sub[np.lexsort((doc[sub], v[sub], h[sub]))]
    return o


_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
_OUT_SQL = "part int, kind tinyint, payload binary"
_RUNS, _CUT, _ASK, _SPREAD, _MARK = 0, 1, 2, 3, 4
#: kinds of the second exchange, beside the ranges 0 to FINE - 1
_STRINGS, _CUT_HOME = 100, 101


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    batch, size = [], 0
    for r in rows:
        batch.append(r)
        size += len(r[2])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _OUT)], schema=_OUT)
            batch, size = [], 0
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _OUT)], schema=_OUT)


def _by_part(part: np.ndarray, kind: int, cols: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    o = np.argsort(part, kind="stable")
    part = part[o]
    cut = np.r_[runs(part), len(part)]
    cols = [c[o] for c in cols]
    return [(int(part[s]), kind, pack(*(c[s:e] for c in cols))) for s, e in zip(cut[:-1], cut[1:])]


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """The partition of an anchor; anchors are minima, so their hashes are hashed again."""
    return bucket_of(mix64(h + np.uint64(_BASE)), n)


def _lead(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the place of the first row with the same keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _runs_cell(h, v, pos, count, doc, ids, keys) -> bytes:
    docs, local = np.unique(doc, return_inverse=True)
    local = local.astype(np.uint16 if len(docs) < 65536 else np.uint32)
    cell = pack(h, v, pos.astype(np.uint16) if pos.max() < 65536 else pos, count, local)
    return pack(np.frombuffer(cell, np.uint8), ids[docs], keys[docs])


def _map_runs(n_parts: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            data, off = text_buffers(b.column(2))
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in text_slices(off, SLICE):
                cols = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], length, k)
                held.append((cols, ids[i:j], keys[i:j]))
                size += len(cols[0])
                if size >= FLUSH:
                    yield from _rows(flush(held))
                    held, size = [], 0
        if held:
            yield from _rows(flush(held))

    def flush(held: list[tuple]) -> list[tuple[int, int, bytes]]:
        base = np.cumsum([0, *(len(x[1]) for x in held)])
        ids, keys = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        h, v, doc, pos, count = (np.concatenate(c) for c in zip(*((c[0], c[1], c[2].astype(np.int64) + s, c[3], c[4]) for (c, *_), s in zip(held, base))))
        held.clear()
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)  # equal ids rank alike
        o = _order(h, v, rank[doc])
        h, v, doc, pos, count = (c[o] for c in (h, v, doc, pos, count))
        lead = _lead(h, v)
        later = rank[doc] > rank[doc[lead]]
        rows = []
        gone = np.flatnonzero(later)
        if len(gone):
            d = doc[gone]
            rows += _by_part(_home(keys[d], n_parts), _CUT, [ids[d], keys[d], pos[gone], _all(count[gone])])
        hs = runs(h)
        left = np.add.reduceat((~later).astype(np.int64), hs) if len(h) else hs
        is_hot = np.repeat(left > HOT, np.diff(np.r_[hs, len(h)]))
        hot = np.flatnonzero(is_hot & ~later)
        if len(hot):
            marks = h[hs[left > HOT]]
            rows += _by_part(_spread(marks, n_parts), _MARK, [marks])
            part = bucket_of(mix64(v[hot]), n_parts)
            o = np.argsort(part, kind="stable")
            hot, part = hot[o], part[o]
            cut = np.r_[runs(part), len(part)]
            for s, e in zip(cut[:-1], cut[1:]):
                x = hot[s:e]
                rows.append((int(part[s]), _SPREAD, _runs_cell(h[x], v[x], pos[x], count[x], doc[x], ids, keys)))
        keep = np.flatnonzero(~later & ~is_hot)
        bucket = _spread(h[keep], n_parts)
        o = np.argsort(bucket, kind="stable")
        keep, bucket = keep[o], bucket[o]
        cut = np.r_[runs(bucket), len(bucket)]
        for s, e in zip(cut[:-1], cut[1:]):
            x = keep[s:e]
            rows.append((int(bucket[s]), _RUNS, _runs_cell(h[x], v[x], pos[x], count[x], doc[x], ids, keys)))
        return rows

    return lean(run)


def _all(count: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint64)


def _reduce_runs(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {_RUNS: [], _SPREAD: []}
        marks = [np.zeros(0, np.uint64)]
        for b in batches:
            kind = b.column(1).to_numpy()
            for i in np.flatnonzero(kind != _CUT):
                cols = unpack(b.column(2)[int(i)].as_buffer())
                if kind[i] == _MARK:
                    marks += cols
                else:
                    held[int(kind[i])].append((unpack(cols[0].tobytes()), *cols[1:]))
            cuts = b.filter(pa.array(kind == _CUT))
            if cuts.num_rows:
                yield cuts
        for kind in (_RUNS, _SPREAD):
            if held[kind]:
                yield from _rows(answer(held[kind], kind == _SPREAD, np.unique(np.concatenate(marks))))

    def answer(held, hot: bool, marks: np.ndarray) -> list[tuple[int, int, bytes]]:
        base = np.cumsum([0, *(len(x[1]) for x in held)])
        ids, keys = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        h, v, pos, count = (np.concatenate([x[0][i] for x in held]) for i in range(4))
        doc = np.concatenate([x[0][4].astype(np.int32) + np.int32(s) for x, s in zip(held, base)])
        held.clear()
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        o = _order(h, v, rank[doc])
        h, v, pos, count, doc = (c[o] for c in (h, v, pos, count, doc))
        r = rank[doc]
        lead = _lead(h, v)
        later = r > r[lead]
        if hot:
            ask, is_hot = ~later, np.ones(len(h), bool)
        else:
            hs = runs(h)
            size = np.diff(np.r_[hs, len(h)])
            kinds = np.add.reduceat((lead == np.arange(len(h))).astype(np.int32), hs)
            marked = np.isin(h[hs], marks, assume_unique=True)
            shared = (np.minimum.reduceat(r, hs) != np.maximum.reduceat(r, hs)) & (kinds > 1)
            ask = np.repeat(shared | marked, size) & ~later
            is_hot = np.repeat(marked | (np.add.reduceat((~later).astype(np.int32), hs) > HOT), size)
        rows = []
        gone, want = np.flatnonzero(later), np.flatnonzero(ask)
        if len(gone):
            d = doc[gone]
            rows += _by_part(_home(keys[d], n_parts), _CUT, [ids[d], keys[d], pos[gone].astype(np.uint32), _all(count[gone])])
        if len(want):
            d = doc[want]
            rows += _by_part(_home(keys[d], n_parts), _ASK, [ids[d], keys[d], pos[want].astype(np.uint32), h[want], count[want], is_hot[want].astype(np.uint8)])
        return rows

    return lean(run)


def _home(keys: np.ndarray, n: int) -> np.ndarray:
    """The partition of a document, from the key of its id and text."""
    return bucket_of(keys.view(np.uint64), n)


def _match(ids, keys, want_ids, want_keys) -> tuple[np.ndarray, np.ndarray]:
    """(row, wish) for each wish and each row of the same id and key."""
    o = np.argsort(keys, kind="stable")
    code = keys[o]
    s, e = np.searchsorted(code, want_keys, "left"), np.searchsorted(code, want_keys, "right")
    n = e - s
    wish = np.repeat(np.arange(len(want_keys)), n)
    row = o[np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
    good = ids[row] == want_ids[wish]
    return row[good], wish[good]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _doc_cols(t: pa.Table):
    t = t.combine_chunks()
    return t.column("__tsr_id").to_numpy(), t.column("__tsr_key").to_numpy(), *text_buffers(t.column("__tsr_text"))


def _contexts(n_parts: int, length: int):
    def run(key, docs: pa.Table, asks: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or asks.num_rows == 0:
            return _OUT.empty_table()
        ids, keys, data, off = _doc_cols(docs)
        want_ids, want_keys, pos, h, count, hot = join_packed(c.as_buffer() for c in asks.column("payload"))
        row, wish = _match(ids, keys, want_ids, want_keys)
        first = np.sort(np.unique(wish, return_index=True)[1])  # rows that are copies of each other ask once
        row, wish = row[first], wish[first]
        size = count[wish].astype(np.int64) + (length - 1)
        text_at = off[row] + pos[wish]
        good = text_at + size <= off[row + 1]
        row, wish, size, text_at = row[good], wish[good], size[good], text_at[good]
        x = hot[wish] > 0
        out = strings(want_ids, want_keys, pos, wish[x], _gather(data, text_at[x], size[x]), size[x])
        row, wish, size, text_at = row[~x], wish[~x], size[~x], text_at[~x]
        part = _spread(h[wish], n_parts * FINE)
        o = np.argsort(part, kind="stable")
        row, wish, size, text_at, part = (c[o] for c in (row, wish, size, text_at, part))
        cut = np.r_[runs(part), len(part)]
        for s, e in zip(cut[:-1], cut[1:]):
            w = wish[s:e]
            body = _gather(data, text_at[s:e], size[s:e])
            cols = pack(want_ids[w], want_keys[w], pos[w], count[w])
            out.append((int(part[s]) // FINE, int(part[s]) % FINE, pack(np.frombuffer(cols, np.uint8), body)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT) if out else _OUT.empty_table()

    def strings(ids, keys, pos, wish, body, size) -> list[tuple[int, int, bytes]]:
        """The strings of hot anchors; of equal ones the smallest document's."""
        if not len(wish):
            return []
        at = np.cumsum(size) - size
        n = size - (length - 1)
        entry = np.repeat(np.arange(len(n)), n)
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w1, w2 = fingerprints(body, at[entry] + bit, length)
        d, p = wish[entry], pos[wish][entry] + bit.astype(np.uint32)
        out, keep = _smallest(ids, keys, d, p, w1, w2, n_parts)
        out = [(part, _CUT_HOME, cell) for part, _, cell in out]
        d, p, w1, w2 = d[keep], p[keep], w1[keep], w2[keep]
        part = bucket_of(w1, n_parts)
        cut = np.r_[runs(part), len(part)]
        for s, e in zip(cut[:-1], cut[1:]):
            out.append((int(part[s]), _STRINGS, pack(w1[s:e], w2[s:e], ids[d[s:e]], keys[d[s:e]], p[s:e])))
        return out

    return run


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the strings at ``starts``."""
    letters, up, down = _tables()
    out = []
    for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        table_ = mix64(letters ^ salt)
        h = np.empty(len(starts), np.uint64)
        step = CHUNK - length
        o = np.argsort(starts, kind="stable")
        cuts = np.searchsorted(starts[o], np.arange(0, len(data) + step, step))
        for c, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a == z:
                continue
            d = data[c * step : c * step + CHUNK]
            sums = np.r_[np.uint64(0), np.cumsum(table_[d] * up[: len(d)])]
            s = starts[o[a:z]] - c * step
            h[o[a:z]] = mix64((sums[s + length] - sums[s]) * down[s] + salt)
        out.append(h)
    return out[0], out[1]


def _smallest(ids, keys, d, p, w1, w2, n_parts: int):
    """Cuts for strings that a smaller document here has, and the others' rows."""
    rank = np.unique(ids, return_inverse=True)[1][d]
    o = np.lexsort((rank, w2, w1))
    lead = _lead(w1[o], w2[o])
    later = rank[o] > rank[o][lead]
    gone = o[later]
    rows = _by_part(_home(keys[d[gone]], n_parts), _CUT, [ids[d[gone]], keys[d[gone]], p[gone], np.ones(len(gone), np.uint64)]) if len(gone) else []
    return rows, o[~later]


def qgram_buckets(data: np.ndarray) -> np.ndarray:
    """Initial buckets: the 8 bytes from each position, as a number."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    g = padded[:n]
    for i in range(1, 8):
        g = (g << np.uint64(8)) | padded[i : n + i]
    return g


def refine(bptr: np.ndarray, live: np.ndarray, offset: int) -> np.ndarray:
    """One pass of bucket-pointer refinement.

    ``bptr[i]`` is the start of the bucket of position i in suffix order.
    Positions in ``live`` (buckets of two or more) are sorted within their
    buckets by the pointer at ``i + offset``; pointers are updated and the
    positions still in shared buckets are returned for the next pass.
    """
    if len(live) == 0:
        return live
    n = np.int64(len(bptr))
    code = bptr[live] * n + bptr[np.minimum(live + offset, n - 1)]
    o = np.argsort(code, kind="stable")
    code, pos = code[o], live[o]
    old = code // n
    starts = runs(code)
    sub = np.zeros(len(code), np.int64)
    sub[starts] = starts
    sub = np.maximum.accumulate(sub)
    old_starts = runs(old)
    first = np.zeros(len(code), np.int64)
    first[old_starts] = old_starts
    first = np.maximum.accumulate(first)
    bptr[pos] = old + (sub - first)
    size = np.diff(np.r_[starts, len(code)])
    return pos[np.repeat(size > 1, size)]


def string_buckets(data: np.ndarray, starts: np.ndarray, length: int = L_BYTES) -> np.ndarray:
    """For each start, the bucket pointer of its ``length``-byte string.

    Buckets of 8-grams are refined at offsets 8, 16, ... until they cover the
    string; the pointers of one pass are the sort keys of the next.
    """
    q = 8
    grams = qgram_buckets(data)
    o = np.argsort(grams, kind="stable")
    g = grams[o]
    s = runs(g)
    size = np.diff(np.r_[s, len(g)])
    bptr = np.empty(len(data), np.int64)
    bptr[o] = np.repeat(s, size)
    live = o[np.repeat(size > 1, size)]
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        live = refine(bptr, live, step)
        depth += step
    return bptr[starts]


def _refine_contexts(n_parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            kind = b.column(1).to_numpy()
            for i in np.flatnonzero(kind != _CUT_HOME):
                held.setdefault(int(kind[i]), []).append(b.column(2)[int(i)].as_py())
            cuts = b.filter(pa.array(kind == _CUT_HOME))
            if cuts.num_rows:
                yield cuts
        for kind in sorted(held):
            yield from _rows((strings if kind == _STRINGS else answer)(held.pop(kind)))

    def strings(cells: list[bytes]) -> list[tuple[int, int, bytes]]:
        w1, w2, ids, keys, p = join_packed(cells)
        return _smallest(ids, keys, np.arange(len(ids)), p, w1, w2, n_parts)[0]

    def answer(cells: list[bytes]) -> list[tuple[int, int, bytes]]:
        heads, bodies = [], []
        for c in cells:
            cols, body = unpack(c)
            heads.append(unpack(cols.tobytes()))
            bodies.append(body)
        ids, keys, pos, count = (np.concatenate(c) for c in zip(*heads))
        data = np.concatenate(bodies)
        n = count.astype(np.int64)
        size = n + (length - 1)
        at = np.cumsum(size) - size
        entry = np.repeat(np.arange(len(n)), n)
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bucket = string_buckets(data, at[entry] + bit, length)
        rank = np.unique(ids, return_inverse=True)[1][entry]
        o = np.argsort(bucket, kind="stable")
        s = runs(bucket[o])
        least = np.empty(len(o), np.int64)
        least[o] = np.repeat(np.minimum.reduceat(rank[o], s), np.diff(np.r_[s, len(o)]))
        mask = np.zeros(len(n), np.uint64)
        gone = rank > least
        np.bitwise_or.at(mask, entry[gone], np.uint64(1) << bit[gone].astype(np.uint64))
        hit = np.flatnonzero(mask)
        if not len(hit):
            return []
        return _by_part(_home(keys[hit], n_parts), _CUT, [ids[hit], keys[hit], pos[hit], mask[hit]])

    return lean(run)


def cover(n: int, start: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes lie in a string that goes."""
    delta = np.zeros(n + 1, np.int32)
    for bit in range(int(mask.max()).bit_length() if len(mask) else 0):
        s = start[(mask >> np.uint64(bit)) & np.uint64(1) != 0] + bit
        np.add.at(delta, s, 1)
        np.subtract.at(delta, s + length, 1)
    return np.cumsum(delta[:-1], dtype=np.int32) > 0


def _cut_texts(schema: pa.Schema, length: int, keep_text: bool):
    def run(key, docs: pa.Table, cuts: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return schema.empty_table()
        ids, keys, data, off = _doc_cols(docs)
        row = np.zeros(0, np.int64)
        if cuts.num_rows:
            want_ids, want_keys, pos, mask = join_packed(c.as_buffer() for c in cuts.column("payload"))
            row, wish = _match(ids, keys, want_ids, want_keys)
            o = np.argsort(row, kind="stable")
            row, wish = row[o], wish[o]
            start, mask = off[row] + pos[wish], mask[wish]
        n_removed, n_spans, sha, texts = [], [], [], []
        i = 0
        while i < len(ids):  # about CHUNK bytes at a time
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
            lo, part = off[i : j + 1] - off[i], data[off[i] : off[j]]
            a, z = np.searchsorted(row, [i, j])
            if a == z:
                n_removed.append(np.zeros(j - i, np.int64))
                n_spans.append(np.zeros(j - i, np.int64))
                left, place = part.tobytes(), lo
            else:
                gone = cover(len(part), start[a:z] - off[i], mask[a:z], length)
                removed = np.r_[0, np.cumsum(gone)]
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                first = lo[:-1][lo[:-1] < len(part)]
                edge[first] = gone[first]
                edges = np.r_[0, np.cumsum(edge)]
                left, place = part[~gone].tobytes(), lo - removed[lo]
                n_removed.append(np.diff(removed[lo]))
                n_spans.append(np.diff(edges[lo]))
            kept = [left[s:e] for s, e in zip(place[:-1], place[1:])]
            sha += [hashlib.sha256(x).hexdigest() for x in kept]
            if keep_text:
                texts += [x.decode("utf-8", "ignore") for x in kept]
            i = j
        n_removed = np.concatenate(n_removed)
        out = {
            "__tsr_n_bytes": pa.array(np.diff(off)),
            "__tsr_n_removed": pa.array(n_removed),
            "__tsr_n_spans": pa.array(np.concatenate(n_spans)),
            "__tsr_sha": pa.array(sha, pa.string()),
        }
        if keep_text:
            null = np.asarray(docs.column("__tsr_text").is_null())
            out["__tsr_text"] = pa.array([None if z else x for x, z in zip(texts, null)], pa.string())
        cols = [out[f.name] if f.name in out else docs.column(f.name) for f in schema]
        trim()
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = L_BYTES, k: int = K_GRAM, keep_text: bool = True) -> DataFrame:
    """``df`` with repeated strings cut out of its texts.

    Columns ``__tsr_n_bytes``, ``__tsr_n_removed``, ``__tsr_n_spans`` and
    ``__tsr_sha`` (SHA-256 of the remaining bytes) are added.  With
    ``keep_text`` the text column holds what remains (characters that a cut
    splits go), else it is dropped.  ``length - k`` must be under 64.
    """
    if not 8 <= k <= length or length - k + 1 > 63:
        raise ValueError("8 <= k <= length < k + 63 is needed")
    spark = df.sparkSession
    ship(spark)
    n = fan_out(df)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    key = F.xxhash64(ident, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    base = df.select(ident.alias("__tsr_id"), key.alias("__tsr_key"), F.col(f"`{text_col}`").alias("__tsr_text"))

    found = base.mapInArrow(_map_runs(n, length, k), _OUT_SQL).repartitionById(n, F.col("part")).mapInArrow(_reduce_runs(n), _OUT_SQL)
    found = materialize(found, "runs")

    # the same exchange of the texts serves both joins
    others = [c for c in df.columns if c != text_col]
    tail = [F.col(f"`{c}`").alias(f"__tsr_c{i}") for i, c in enumerate(others)] if keep_text else [F.col(f"`{id_col}`").alias("__tsr_c0")]
    names = others if keep_text else [id_col]
    docs = df.select(ident.alias("__tsr_id"), key.alias("__tsr_key"), F.col(f"`{text_col}`").alias("__tsr_text"), *tail)
    docs = docs.withColumn("part", F.shiftrightunsigned(F.shiftrightunsigned("__tsr_key", 32) * F.lit(n), 32).cast("int"))
    asks = found.where(F.col("kind") == _ASK).select("part", "payload")
    contexts = docs.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_contexts(n, length), _OUT_SQL)
    cuts = contexts.repartitionById(n, F.col("part")).mapInArrow(_refine_contexts(n, length), _OUT_SQL)
    cuts = found.where(F.col("kind") == _CUT).select("part", "payload").unionByName(cuts.select("part", "payload"))
    fields = [f for f in docs.schema.fields if f.name.startswith("__tsr_c")]
    extra = "__tsr_n_bytes long, __tsr_n_removed long, __tsr_n_spans long, __tsr_sha string" + (", __tsr_text string" if keep_text else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(fields + _parse_datatype_string(extra).fields)
    done = docs.groupBy("part").cogroup(cuts.groupBy("part")).applyInArrow(_cut_texts(to_arrow_schema(schema), length, keep_text), schema)
    back = {c: f"__tsr_c{i}" for i, c in enumerate(names)}
    order = df.columns if keep_text else [id_col]
    return done.select(*(F.col(back[c]).alias(c) if c in back else F.col("__tsr_text").alias(c) for c in order), "__tsr_n_bytes", "__tsr_n_removed", "__tsr_n_spans", "__tsr_sha")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut repeated 50-byte strings out of every document."""
    done = suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return done.select(
        "doc_id",
        F.col("__tsr_n_bytes").alias("n_bytes"),
        F.col("__tsr_n_removed").alias("n_removed"),
        F.col("__tsr_n_spans").alias("n_spans"),
        F.col("__tsr_sha").alias("kept_sha256"),
    )
