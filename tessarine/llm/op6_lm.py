"""Language-model scoring with a causal self-attention model in numpy.

Training documents are those whose crc32(id as text) mod 7 is not 2.

1. *Encode* (map only): texts, A-Z lower-cased, become cells of about CELL
   bytes: the different words with their hashes and subword ids once, then the
   words' places in that list.  The cells are a table; no text is read again.
2. *Count*: training words by hash range (combined in each cell first), the
   pairs of neighbouring ids within words, and for each id a vector of the
   company it keeps (sums of fixed random signs of the ids near it).
3. Ids with like company get one of CLASSES classes (k-means on the driver over
   one vector an id).  A word's class is that of its first id.
4. *Train*: an attention model over windows of words (:mod:`.attention`)
   predicts the next word's class, or the end.  Every training window is used
   in one of TURNS rounds (by hash, in growing shares), EPOCHS times in all;
   each round's tasks train side by side and their weights are averaged.
5. *Score*: P(word | before) = P(class | before) * P(word | class), where
   P(word | class) = max(c - D, 0) / N_class + D * V_class / N_class * P(spelling):
   absolute discounting, D from the counts of counts, so that the words of a
   class add up to at most one.  The spelling is its ids: the first within
   the class, the others and the word's end by discounted id pairs.  Words with
   the same ids (none, or unlike letters) share their spelling: see `apart`.
   At most PAIRS pairs are a table; words with rarer pairs meet these by the
   pair's hash range, and what they add to a spelling goes to the word's.
   Counts of the HEAVY most frequent words are a table of bounded size; the
   others' occurrences meet by hash range, where counts follow from the
   occurrences themselves, and come back as sums a document.

Each document's end is predicted like a word.  A null text is empty (its only
token is the end).  A null id is hashed as the empty text.  Repeated rows
count, and are scored, each time.  An empty table gives an empty result; with
no training document every word is spelled.  Texts of any length are whole: one
longer than CELL is a cell of its own.  Columns other than the two are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention as net
from .common import bucket_of, fan_out, lean, materialize, mix64, pack, runs, ship, table, text_buffers, text_slices, unpack
from .words import default_path, hashed_encoder, release

CELL = 3 << 20
HEAVY = 100_000
PAIRS = 400_000
#: shares of the windows in each training round, in sixteenths
TURNS = (2, 6, 8)
RATES = (1e-2, 6e-3, 2e-3)
EPOCHS = 1
SIGNS = 16
#: probability that a spelling stands for another word than the one its ids spell
OTHER = 1e-3

_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
_OUT_SQL = "part int, kind tinyint, payload binary"
_WORDS, _PAIRS, _NEAR, _TOTALS, _FIRST, _SIZES, _TAIL, _DOC, _SUMS, _ASKED, _RARE = range(11)
_CELL_SQL = "counted binary, spelled binary, places binary, docs binary"
_CELL = pa.schema([(n, pa.binary()) for n in ("counted", "spelled", "places", "docs")])


def _rows(rows) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 128):
        part = rows[i : i + 128]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _OUT)], schema=_OUT)


def _split(part: np.ndarray, kind: int, cols: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    o = np.argsort(part, kind="stable")
    part, cols = part[o], [c[o] for c in cols]
    cut = np.r_[runs(part), len(part)]
    return [(int(part[s]), kind, pack(*(c[s:e].ravel() for c in cols))) for s, e in zip(cut[:-1], cut[1:])]


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def same_spelling(words: list[bytes]) -> np.ndarray:
    """Which lower-cased words are what their ids spell (others share ids with another word)."""
    out = np.ones(len(words), bool)
    odd = [i for i, w in enumerate(words) if not w.isascii()]
    for i in range(0, len(odd), 256):
        part = odd[i : i + 256]
        lines = b"\n".join([words[x] for x in part]).decode("utf-8", "replace")
        if lines.split() == lines.split("\n") and unicodedata.is_normalized("NFC", lines) and lines.lower() == lines and "\ufffd" not in lines:
            continue
        for x in part:
            t = words[x].decode("utf-8", "replace")
            out[x] = unicodedata.normalize("NFC", t).lower() == t and len(t.split()) == 1 and t == t.strip() and "\ufffd" not in t
    return out


def _encode(path: str, odd: int):
    """(key, id, training, text) -> cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = hashed_encoder(path, same_spelling)
        for b in batches:
            keys, ids, train = b.column(0).to_numpy(), b.column(1), np.asarray(b.column(2))
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            data, off = text_buffers(b.column(3))
            for i, j in text_slices(off, CELL):
                numbers, n = enc.numbers(data[off[i] : off[j]], off[i : j + 1] - off[i])
                here = np.zeros(enc.n, bool)
                here[numbers] = True
                uniq = np.flatnonzero(here)
                uniq = uniq[net.falling(enc.size.a[uniq])]  # which `net.Words` sums quickest
                lut = np.zeros(enc.n, np.int32)
                lut[uniq] = np.arange(len(uniq))
                seq = lut[numbers]
                times = np.bincount(seq[np.repeat(train[i:j], n)], minlength=len(uniq))
                size = enc.size.a[uniq].astype(np.int64)
                upto = np.cumsum(size) - size
                flat = enc.ids.a[np.repeat(enc.start.a[uniq] - upto, size) + np.arange(size.sum())].astype(np.int32)
                none = size == 0  # a word that the tokenizer drops has an id of its own
                if none.any():
                    flat = np.insert(flat, upto[none], odd)
                    size = np.maximum(size, 1)
                    upto = np.cumsum(size) - size
                first = flat[upto] if len(upto) else flat[:0]
                plain = enc.plain.a[uniq] & ~none
                extra = np.where(plain, 0, np.minimum(enc.bytes.a[uniq] + 1, 1 << 30))
                cells = [pack(enc.hash.a[uniq], first, _small(times)), pack(_small(flat), _small(size), _small(extra)), pack(_small(seq), _small(n)), pack(keys[i:j], ids[i:j], null[i:j].astype(np.uint8), train[i:j].astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], schema=_CELL)

    return lean(run)


BLOCK = 64


def _signs(size: int) -> np.ndarray:
    return (np.random.default_rng(66).integers(0, 2, (size + 1, 2 * SIGNS)) * 2 - 1).astype(np.int8)


def company(first: np.ndarray, n: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different words of the texts, for each the sum over its places of the signs of the other words in its block of its text, and of the word before)."""
    size = len(signs) - 1
    place = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    start = place % BLOCK == 0
    block = np.add.reduceat(signs[first, :SIGNS], np.flatnonzero(start), axis=0)  # within +-BLOCK
    before = np.full(len(first), size)
    before[1:] = first[:-1]
    before[place == 0] = size
    o = np.argsort(first.astype(np.uint16) if size <= 1 << 16 else first, kind="stable")
    s = runs(first[o])
    who = first[o][s]
    times = np.diff(np.r_[s, len(o)])[:, None]
    both = np.empty((len(o), 2 * SIGNS), np.int8)
    both[:, :SIGNS] = block.take((np.cumsum(start) - 1)[o], axis=0)
    both[:, SIGNS:] = np.ascontiguousarray(signs[:, SIGNS:]).take(before[o], axis=0)
    sums = np.add.reduceat(both, s, axis=0, dtype=np.int32)
    sums[:, :SIGNS] -= times * signs[who, :SIGNS]
    return who, sums


def _count(n_parts: int, end: int):
    """Cells -> counts of training words, id pairs and the company of ids.  Ids up to ``end`` - 1; ``end`` ends a word."""
    signs = _signs(end + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        near = np.zeros((end + 1, 2 * SIGNS), np.int64)
        tokens = docs = 0
        held: list[tuple] = []
        pairs: list[np.ndarray] = []
        size = 0
        for b in batches:
            for row in range(b.num_rows):
                h, first, times = unpack(b.column(0)[row].as_buffer())
                flat, n_ids, _ = unpack(b.column(1)[row].as_buffer())
                seq, n = (x.astype(np.int64) for x in unpack(b.column(2)[row].as_buffer()))
                train = unpack(b.column(3)[row].as_buffer())[3] > 0
                got = times > 0
                held.append((h[got], first[got], times[got].astype(np.int64)))
                size += int(got.sum())
                flat, n_ids = flat[np.repeat(got, n_ids)].astype(np.int64), n_ids[got].astype(np.int64)
                nxt = np.r_[flat[1:], end] if len(flat) else flat
                nxt[np.cumsum(n_ids) - 1] = end
                p, c = np.unique(flat * (end + 1) + nxt, return_counts=True)
                pairs.append(np.stack([p, c]))
                seq, n = seq[np.repeat(train, n)], n[train]
                tokens += len(seq) + len(n)
                docs += len(n)
                ids = first[seq]
                if len(ids):
                    at, sums = company(ids, n, signs)
                    near[at] += sums
                if size > 2_000_000:
                    yield from _rows(flush(held, pairs))
                    size = 0
        yield from _rows(flush(held, pairs))
        who = np.flatnonzero(near.any(axis=1))
        if len(who):
            part = (who * n_parts) // (end + 1)
            yield from _rows(_split(part, _NEAR, [who, near[who].astype(np.int32)]))
        yield from _rows([(0, _TOTALS, pack(np.array([tokens]), np.array([docs])))])

    def flush(held, pairs):
        out = []
        if held:
            h, first, n = (np.concatenate(c) for c in zip(*held))
            o = np.argsort(h, kind="stable")
            s = runs(h[o])
            h, first, n = h[o][s], first[o][s], np.add.reduceat(n[o], s) if len(s) else n
            out += _split(bucket_of(h, n_parts), _WORDS, [h, first, _small(n)])
        if pairs:
            p, c = np.concatenate(pairs, axis=1)
            o = np.argsort(p, kind="stable")
            s = runs(p[o])
            p, c = p[o][s], np.add.reduceat(c[o], s) if len(s) else c
            out += _split(bucket_of(mix64(p.view(np.uint64)), n_parts), _PAIRS, [p, c])
        held.clear()
        pairs.clear()
        return out

    return lean(run)


def _log2(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.floor(np.log2(n)).astype(np.int64), minlength=64)


def _reduce_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by word, pair and id; for each first id its words and their occurrences; how many counts are how large."""
    held: dict[int, list] = {_WORDS: [], _PAIRS: [], _NEAR: []}
    for b in batches:
        kind = b.column(1).to_numpy()
        for i in np.flatnonzero(kind != _TOTALS):
            held[int(kind[i])].append(unpack(b.column(2)[int(i)].as_buffer()))
        other = b.filter(pa.array(kind == _TOTALS))
        if other.num_rows:
            yield other
    sizes = np.zeros((2, 64), np.int64)
    few = np.zeros(2, np.int64)
    if held[_WORDS]:
        h, first, n = (np.concatenate([np.asarray(x[i], (None, None, np.int64)[i]) for x in held[_WORDS]]) for i in range(3))
        o = np.argsort(h, kind="stable")
        h, s = h[o], runs(h[o])
        h, first, n = h[s], first[o][s].astype(np.int64), np.add.reduceat(n[o], s) if len(s) else n
        if len(h):
            sizes[0] = _log2(n)
            few = np.array([(n == 1).sum(), (n == 2).sum()])
            yield from _rows([(0, _WORDS, pack(h, _small(first), _small(n)))])
            o = np.argsort(first, kind="stable")
            s = runs(first[o])
            yield from _rows([(0, _FIRST, pack(first[o][s], np.add.reduceat(n[o], s), np.diff(np.r_[s, len(o)])))])
    if held[_PAIRS]:
        p, c = (np.concatenate(x) for x in zip(*held[_PAIRS]))
        o = np.argsort(p, kind="stable")
        s = runs(p[o])
        if len(s):
            p, c = p[o][s], np.add.reduceat(c[o], s)
            sizes[1] = _log2(c)
            yield from _rows([(0, _PAIRS, pack(p, c))])
    if held[_NEAR]:
        who = np.concatenate([x[0] for x in held[_NEAR]])
        near = np.concatenate([x[1].reshape(-1, 2 * SIGNS) for x in held[_NEAR]]).astype(np.int64)
        o = np.argsort(who, kind="stable")
        s = runs(who[o])
        yield from _rows([(0, _NEAR, pack(who[o][s], np.add.reduceat(near[o], s, axis=0).ravel()))])
    yield from _rows([(0, _SIZES, pack(np.r_[few, sizes.ravel()]))])


def _columns(names: list[str], least: int = 0):
    """Packed cells as rows; those whose last column is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                cols = [x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in unpack(c.as_buffer())]
                pick = cols[-1] >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in cols], names=names)

    return lean(run)


def _sum_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed cells of one length as their sum."""
    total = None
    for b in batches:
        for c in b.column(0):
            x = unpack(c.as_buffer())[0].astype(np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])


def least_of(hist: np.ndarray, room: int) -> int:
    """The power of two from which on at most ``room`` counts remain."""
    k = 63
    while k >= 0 and hist[k] <= room:
        room -= hist[k]
        k -= 1
    return 1 << (k + 1)


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted k-means of rows; a fixed start, so equal input gives equal classes."""
    r = np.random.default_rng(9)
    centre = x[r.choice(len(x), min(k, len(x)), replace=False, p=weight / weight.sum())] if len(x) else x
    best = np.zeros(len(x), np.int64)
    for _ in range(rounds if len(x) else 0):
        best = np.concatenate([np.argmax(x[i : i + 8192] @ centre.T - (centre * centre).sum(axis=1) / 2, axis=1) for i in range(0, len(x), 8192)])
        mass = np.bincount(best, weights=weight, minlength=len(centre))
        for d in range(x.shape[1]):
            centre[:, d] = np.where(mass > 0, np.bincount(best, weights=weight * x[:, d], minlength=len(centre)) / np.maximum(mass, 1e-12), centre[:, d])
    return best


class Places:
    """Where hashes stand, or would, among sorted ones: their top bits lead next to it."""

    def __init__(self, h: np.ndarray):
        self.n, self.h = len(h), np.r_[h, ~np.uint64(0)]
        bits = max(1, self.n.bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(h >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return self.n

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which of the hashes are there); a place is less than 1 or the number of hashes."""
        at = self.start.take((x >> self.shift).view(np.int64))
        todo = np.flatnonzero(self.h.take(at) < x)
        while len(todo):
            at[todo] += 1
            todo = todo[self.h.take(at[todo]) < x[todo]]
        hit = (self.h.take(at) == x) & (at < self.n)
        return np.minimum(at, max(self.n - 1, 0)), hit


def _code(key: np.ndarray) -> np.ndarray:
    return mix64(key.view(np.uint64))


class Vocabulary:
    """Classes of the ids, what is counted by class, and how words are spelled."""

    def __init__(self, end: int, tokens: int, docs: int, first: tuple, near: tuple, few: tuple, pairs: tuple, before: np.ndarray, after: np.ndarray, kinds: np.ndarray | None = None):
        """kinds: how many different ids follow an id, if ``pairs`` aren't all there are."""
        self.end, self.tokens, self.docs = end, tokens, docs
        n, v = np.zeros(end), np.zeros(end)  # occurrences and words by first id
        n[first[0]], v[first[0]] = first[1], first[2]
        vec = np.zeros((end, 2 * SIGNS))
        vec[near[0]] = near[1]
        seen = n > 0
        mean = vec.sum(axis=0) / max(n.sum(), 1)
        x = vec[seen] / n[seen][:, None] - mean
        x *= (n[seen] / (n[seen] + 8))[:, None]
        for half in (slice(0, SIGNS), slice(SIGNS, None)):
            x[:, half] /= max(float(np.sqrt((x[:, half] ** 2).sum(axis=1) @ n[seen] / max(n.sum(), 1))), 1e-9)
        self.cls = np.arange(end) % net.CLASSES
        self.cls[seen] = clusters(x, np.sqrt(n[seen]), net.CLASSES)
        self.n, self.v = (np.bincount(self.cls, weights=w, minlength=net.CLASSES) for w in (n, v))
        self.d = few[0] / (few[0] + 2 * few[1]) if few[0] and few[1] else 0.5
        share = np.r_[self.n, docs] + 0.5
        self.share = np.log(share / share.sum())
        with np.errstate(divide="ignore"):
            self.log_n = np.log10(self.n)
            spare = np.where(self.n > 0, self.d * self.v / np.maximum(self.n, 1), 1.0)
        w = v + 0.05
        self.log_first = np.log10(spare[self.cls] * w / np.bincount(self.cls, weights=w, minlength=net.CLASSES)[self.cls])
        # what follows an id within a word; ``end`` is the word's end
        key, count = pairs
        key, count = key.astype(np.int64), count.astype(float)
        o = np.argsort(_code(key))
        key, count = key[o], count[o]
        self.pair = Places(_code(key))
        prev = key // (end + 1)
        own = (after + 0.05) / (after.sum() + 0.05 * (end + 1))
        kept = (count - 0.5) / np.maximum(before[prev], 1)
        if kinds is None:
            left = np.where(before > 0, 1 - np.bincount(prev, weights=kept, minlength=end), 1.0)
        else:
            left = np.where(before > 0, 0.5 * kinds / np.maximum(before, 1), 1.0)
        self.before = before
        self.log_after, self.log_left = np.log10(own), np.log10(np.maximum(left, 1e-12))
        self.log_pair = np.log10(kept + np.maximum(left, 1e-12)[prev] * own[key % (end + 1)])
        # rows of the attention model's tables
        order = np.lexsort((np.arange(end), -n))
        room = net.ROWS - net.CLASSES
        self.row = room + self.cls
        self.row[order[:room]] = np.arange(min(room, end))
        # ids begin as their company says: its principal components, rare rows as their class
        start = np.zeros((end, net.DIM))
        if len(x):
            weight = np.sqrt(n[seen])
            _, axes = np.linalg.eigh((x * weight[:, None]).T @ x)
            y = x @ axes[:, ::-1][:, : net.DIM]
            start[seen] = y * (0.5 / max(float(np.sqrt((y * y).sum(axis=1) @ weight / weight.sum() / net.DIM)), 1e-9))
        self.start = np.zeros((net.ROWS + 1, net.DIM), np.float32)
        mass = np.bincount(self.row, weights=n, minlength=net.ROWS + 1)
        for i in range(net.DIM):
            self.start[:, i] = np.bincount(self.row, weights=n * start[:, i], minlength=net.ROWS + 1) / np.maximum(mass, 1)
        for k in ("log_first", "log_after", "log_left", "log_pair", "log_n"):
            setattr(self, k, getattr(self, k).astype(np.float32))

    def keys(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The pair that each id of words begins; last: the words' last places."""
        nxt = np.r_[flat[1:], self.end] if len(flat) else flat.copy()
        nxt[last] = self.end
        return flat * (self.end + 1) + nxt

    def without(self, key: np.ndarray) -> np.ndarray:
        """log10 of what pairs have that were never counted."""
        return self.log_left[key // (self.end + 1)] + self.log_after[key % (self.end + 1)]

    def missing(self, key: np.ndarray) -> np.ndarray:
        """Which pairs aren't in the table."""
        return ~self.pair.find(_code(key))[1]

    def more(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What counted pairs that aren't in the table have above `without`."""
        none = self.without(key).astype(np.float64)
        return np.log10((count - 0.5) / self.before[key // (self.end + 1)] + 10**none) - none

    def spelled(self, flat: np.ndarray, size: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """log10 of (what a class leaves to unseen words) * P(spelling) of words."""
        flat = flat.astype(np.int64)
        last = np.cumsum(size) - 1
        key = self.keys(flat, last)
        got = self.without(key)
        if len(self.pair):
            at, hit = self.pair.find(_code(key))
            got = np.where(hit, self.log_pair.take(at), got)
        upto = np.r_[0.0, np.cumsum(got, dtype=np.float64)]
        apart = np.where(extra > 0, math.log10(OTHER) - extra * math.log10(257), math.log10(1 - OTHER))
        return self.log_first[flat[last + 1 - size]] + upto[last + 1] - upto[last + 1 - size] + apart

    def words(self, flat: np.ndarray, size: np.ndarray) -> net.Words:
        """Words for the attention model; the last is the start of a text."""
        begin = np.cumsum(size) - size
        rest = np.ones(len(flat), bool)
        rest[begin] = False
        return net.Words(np.r_[self.row[flat[begin]], net.ROWS], self.row[flat[rest]], np.r_[size - 1, 0])


def _with_starts(seq: np.ndarray, n: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(words with the start word before each text, place of each start)."""
    first = np.cumsum(n) - n + np.arange(len(n))
    out = np.full(len(seq) + len(n), start, np.int64)
    body = np.ones(len(out), bool)
    body[first] = False
    out[body] = seq
    return out, first


def _train(p: dict, voc: Vocabulary, rate: float, turn: tuple[int, int]):
    """One task's training on the windows whose hash is in the turn's sixteenths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        adam = net.Adam(p, rate)
        name = 0
        for b in batches:
            for row in range(b.num_rows):
                flat, size, _ = (x.astype(np.int64) for x in unpack(b.column(0)[row].as_buffer()))
                seq, n = (x.astype(np.int64) for x in unpack(b.column(1)[row].as_buffer()))
                keys, _, _, train = unpack(b.column(2)[row].as_buffer())
                train = train > 0
                keys = keys[train]
                seq, n = seq[np.repeat(train, n)], n[train]
                words = voc.words(flat, size)
                target = np.r_[voc.cls[flat[np.cumsum(size) - size]], 0]
                seq, first = _with_starts(seq, n, len(size))
                doc, at = net.windows(n)
                code = mix64(keys.view(np.uint64)[doc] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                slot = code & np.uint64(15)
                pick = np.flatnonzero((slot >= turn[0]) & (slot < turn[1]))
                pick = pick[np.lexsort((at[pick], code[pick]))]
                name = max(name, int(code.max(initial=0) >> np.uint64(1)))
                goal_of = target[seq]
                for i in range(0, len(pick), net.BATCH):
                    x = pick[i : i + net.BATCH]
                    win, goal, _ = net.window_words(seq, first, n, doc[x], at[x], goal_of, net.CLASSES)
                    adam.step(words, win, goal)
        if adam.seen:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([adam.seen]), pa.array([net.flatten(adam.p).tobytes()], pa.binary())], names=["shard", "n", "cell"])

    return lean(run)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((s, n, c) for b in batches for s, n, c in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: r[0])
    if rows:
        total = sum(n for _, n, _ in rows)
        mean = sum(np.frombuffer(c, np.float32).astype(np.float64) * (n / total) for _, n, c in rows)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([total]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["shard", "n", "cell"])


_AVERAGE_SQL = "shard long, n long, cell binary"


def _ask(n_parts: int, voc: Vocabulary):
    """Cells -> (pair, word, times) of the words' pairs that the table doesn't hold, by the pair's hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                h, *_ = unpack(b.column(0)[row].as_buffer())
                flat, size, _ = (x.astype(np.int64) for x in unpack(b.column(1)[row].as_buffer()))
                key = voc.keys(flat, np.cumsum(size) - 1)
                at = np.flatnonzero(voc.missing(key))
                key, word = key[at], np.repeat(np.arange(len(h)), size)[at]
                o = np.lexsort((word, key))
                key, word = key[o], word[o]
                s = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1])]) if len(key) else o
                yield from _rows(_split(bucket_of(mix64(key[s].view(np.uint64)), n_parts), _ASKED, [key[s], h[word[s]], _small(np.diff(np.r_[s, len(key)]))]))

    return lean(run)


def _rare_pairs(n_parts: int, least: int):
    """The counted pairs under ``least``, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                key, count = unpack(c.as_buffer())
                key, count = key[count < least], count[count < least]
                yield from _rows(_split(bucket_of(mix64(key.view(np.uint64)), n_parts), _PAIRS, [key, count]))

    return lean(run)


def _answer(n_parts: int, voc: Vocabulary):
    """What rare pairs add to the spellings of the words that have them, by the word's hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_PAIRS: [], _ASKED: []}
        for b in batches:
            for kind, c in zip(b.column(1).to_pylist(), b.column(2)):
                held[kind].append(unpack(c.as_buffer()))
        if not (held[_PAIRS] and held[_ASKED]):
            return
        pair, count = (np.concatenate(x) for x in zip(*held[_PAIRS]))
        o = np.argsort(pair)
        pair, count = pair[o], count[o]
        some = []
        for key, h, times in held.pop(_ASKED):
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            hit = pair[at] == key
            some.append((at[hit], h[hit], times[hit].astype(np.int64)))
        at, h, times = (np.concatenate(x) for x in zip(*some))
        o = np.lexsort((at, h))  # a word may ask from several cells
        at, h, times = at[o], h[o], times[o]
        s = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else o
        at, h, times = at[s], h[s], times[s]
        yield from _rows(_split(bucket_of(h, n_parts), _RARE, [h, times * voc.more(pair[at], count[at].astype(np.int64))]))

    return lean(run)


def _added(h: np.ndarray, parts: list) -> np.ndarray:
    """For sorted hashes, the sums of the (hash, number) columns given."""
    if not (len(h) and parts):
        return np.zeros(len(h))
    k, x = (np.concatenate(c) for c in zip(*parts))
    at = np.minimum(np.searchsorted(h, k), len(h) - 1)
    hit = h[at] == k
    at, x = at[hit], x[hit]
    o = np.lexsort((x, at))
    return np.bincount(at[o], weights=x[o], minlength=len(h))


def _of_heavy(heavy: np.ndarray):
    """What rare pairs add to heavy words, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(2):
                h, x = unpack(c.as_buffer())
                hit = np.isin(h, heavy)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(x[hit])], names=["h", "x"])

    return lean(run)


def _score(n_parts: int, p: dict, voc: Vocabulary, heavy: np.ndarray, heavy_n: np.ndarray, heavy_more: np.ndarray):
    heavy = Places(heavy)
    base_n = np.log10(heavy_n + 1.0)
    with np.errstate(divide="ignore"):
        known_n = np.log10(heavy_n - voc.d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for row in range(b.num_rows):
                yield from _rows(cell(*(unpack(b.column(i)[row].as_buffer()) for i in range(4))))

    def cell(counted, spelled, places, docs):
        h, first, _ = counted
        flat, size, extra = (x.astype(np.int64) for x in spelled)
        seq, n = (x.astype(np.int64) for x in places)
        keys, ids, null, train = docs
        cls = voc.cls[first]
        target = np.r_[cls, 0]
        led, begin = _with_starts(seq, n, len(h))
        path = net.score_places(p, voc.words(flat, size), led, begin, n, target[led])
        after = np.cumsum(path)
        of_doc = after[begin + n] - after[begin] + path[begin]  # all words' classes and the end
        spell = voc.spelled(flat, size, extra)  # without rare pairs
        at, hit = heavy.find(h)
        base, own = np.zeros(len(h)), np.zeros(len(h))
        base[hit] = base_n[at[hit]]
        spell[hit] += heavy_more[at[hit]]
        own[hit] = np.logaddexp((known_n[at[hit]] - voc.log_n[cls[hit]]) * math.log(10), spell[hit] * math.log(10)) / math.log(10)
        doc = np.repeat(np.arange(len(n)), n)
        sums, score, known = (np.bincount(doc, weights=x[seq], minlength=len(n)) for x in (base, own, hit.astype(np.int64)))
        rows = _split(bucket_of(keys.view(np.uint64), n_parts), _DOC, [keys, ids, null, train, n + 1, known.astype(np.int64), sums, score + of_doc])
        tail = np.flatnonzero(~hit[seq])
        if len(tail):
            w = seq[tail]
            tail = tail[np.argsort(h[w], kind="stable")]
            w, d = seq[tail], doc[tail]
            part = bucket_of(h[w], n_parts)
            cut = np.r_[runs(part), len(part)]
            for x, y in zip(cut[:-1], cut[1:]):
                s = runs(w[x:y])  # each word once, then its occurrences
                who, local = np.unique(d[x:y], return_inverse=True)
                u = w[x:y][s]
                rows.append((int(part[x]), _TAIL, pack(h[u], spell[u].astype(np.float32), cls[u].astype(np.uint8), _small(np.diff(np.r_[s, y - x])), _small(local), keys[who], train[who])))
        return rows

    return lean(run)


def _reduce_tail(n_parts: int, voc: Vocabulary):
    log_n, d = voc.log_n.astype(np.float64), voc.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rare, size = [], [], 0
        for b in batches:
            kind = b.column(1).to_numpy()
            rare += [unpack(b.column(2)[int(i)].as_buffer()) for i in np.flatnonzero(kind == _RARE)]
            for i in np.flatnonzero(kind == _TAIL):
                h, spell, cls, times, local, keys, train = unpack(b.column(2)[int(i)].as_buffer())
                held.append((np.repeat(h, times), np.repeat(spell, times), np.repeat(cls, times), local.astype(np.uint32) + np.uint32(size), keys, train))
                size += len(keys)
            other = b.filter(pa.array((kind != _TAIL) & (kind != _RARE)))
            if other.num_rows:
                yield other
        if not held:
            return
        h, spell, cls, doc, keys, train = (np.concatenate(c) for c in zip(*held))
        held.clear()
        # the same document may come in several cells
        uniq, flat = np.unique(keys, return_inverse=True)
        o = np.lexsort((flat[doc], h))
        h, spell, cls, doc = h[o], spell[o].astype(np.float64), cls[o], doc[o]
        s = runs(h)
        n = np.add.reduceat((train[doc] > 0).astype(np.int64), s)
        spell += np.repeat(_added(h[s], rare), np.diff(np.r_[s, len(h)]))
        n = np.repeat(n, np.diff(np.r_[s, len(h)]))
        who = flat[doc]
        sums = np.bincount(who, weights=np.log10(n + 1.0), minlength=len(uniq))
        known = np.bincount(who, weights=n > 0, minlength=len(uniq)).astype(np.uint32)
        count = np.where(n > 0, np.log10(np.maximum(n - d, 1e-300)) - log_n[cls], -1e3)
        score = np.bincount(who, weights=np.logaddexp(count * math.log(10), spell * math.log(10)) / math.log(10), minlength=len(uniq))
        yield from _rows(_split(bucket_of(uniq.view(np.uint64), n_parts), _SUMS, [uniq, sums, known, score]))

    return lean(run)


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_RESULT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(total: int, docs: int, norm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = [], []
        for b in batches:
            for kind, c in zip(b.column(1).to_pylist(), b.column(2)):
                (own if kind == _DOC else sums).append(unpack(c.as_buffer()))
        if not own:
            return
        key, ids, null, train, words, known, heavy, lm = (np.concatenate(c) for c in zip(*own))
        own.clear()
        uniq, first, flat, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        extra, more, seen = np.zeros(len(uniq)), np.zeros(len(uniq)), np.zeros(len(uniq), np.int64)
        if sums:
            k, s, n, m = (np.concatenate(c) for c in zip(*sums))
            at = np.searchsorted(uniq, k)
            o = np.lexsort((m, s, at))
            extra = np.bincount(at[o], weights=s[o], minlength=len(uniq))
            more = np.bincount(at[o], weights=m[o], minlength=len(uniq))
            seen = np.bincount(at, weights=n, minlength=len(uniq)).astype(np.int64)
        base = heavy + extra[flat] / times[flat] + math.log10(docs + 1) - words * norm
        n_known = known + seen[flat] // times[flat] + (docs > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=null > 0), pa.array(train == 0), pa.array(words), pa.array(n_known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(lm + more[flat] / times[flat])],
            schema=_RESULT,
        )

    return lean(run)


def learn(cells: DataFrame, n: int, end: int) -> tuple[dict, Vocabulary, np.ndarray, np.ndarray, int, DataFrame | None]:
    """(attention weights, vocabulary, hashes and counts of the heavy words, kinds of tokens, what rare pairs add to words)."""
    found = cells.mapInArrow(_count(n, end), _OUT_SQL).repartitionById(n, F.col("part")).mapInArrow(lean(_reduce_counts), _OUT_SQL)
    found = materialize(found, "lm-counts", large_cells=True)

    def of(kind):
        return found.where(F.col("kind") == kind).select("payload")

    def summed(kind, names):
        schema = ", ".join(f"{x} long" for x in names)
        got = of(kind).mapInArrow(_columns(names, -(1 << 63)), schema).groupBy(names[0]).agg(*[F.sum(x).alias(x) for x in names[1:]]).toArrow()
        cols = [got.column(x).to_numpy() for x in names]
        o = np.argsort(cols[0])
        return [c[o] for c in cols]

    totals = of(_TOTALS).mapInArrow(_columns(["tokens", "docs"]), "tokens long, docs long").agg(F.sum("tokens"), F.sum("docs")).first()
    tokens, docs = int(totals[0] or 0), int(totals[1] or 0)
    sizes = np.zeros(130, np.int64)
    for r in of(_SIZES).mapInArrow(lean(_sum_all), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r.k] = r.n
    few, of_words, of_pairs = sizes[:2], sizes[2:66], sizes[66:]
    got = of(_WORDS).mapInArrow(_columns(["h", "first", "n"], least_of(of_words, HEAVY)), "h long, first long, n long").toArrow()
    heavy, heavy_n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    o = np.argsort(heavy)
    least = least_of(of_pairs, PAIRS)
    got = of(_PAIRS).mapInArrow(_columns(["pair", "n"], least), "pair long, n long").toArrow()
    pairs = got.column("pair").to_numpy(), got.column("n").to_numpy()
    both = of(_PAIRS).mapInArrow(_columns(["pair", "n"]), "pair long, n long")
    sides = []
    for side, size in ((F.floor(F.col("pair") / (end + 1)), end), (F.col("pair") % (end + 1), end + 1)):
        x = np.zeros(size)
        t = both.groupBy(side.cast("long").alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
        x[t.column("id").to_numpy()] = t.column("n").to_numpy()
        sides.append(x)
        if len(sides) == 1:
            kinds = np.zeros(size)
            kinds[t.column("id").to_numpy()] = t.column("kinds").to_numpy()
    near = of(_NEAR).mapInArrow(_vectors, "id long, v array<long>").toArrow()
    near_v = near.column("v").combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIGNS) if near.num_rows else np.zeros((0, 2 * SIGNS))
    voc = Vocabulary(end, tokens, docs, summed(_FIRST, ["id", "n", "v"]), (near.column("id").to_numpy(), near_v), tuple(few.tolist()), pairs, *sides, kinds)
    rare = None
    if of_pairs[: least.bit_length() - 1].any():
        asked = cells.select("counted", "spelled").mapInArrow(_ask(n, voc), _OUT_SQL).unionAll(of(_PAIRS).mapInArrow(_rare_pairs(n, least), _OUT_SQL))
        rare = materialize(asked.repartitionById(n, F.col("part")).mapInArrow(_answer(n, voc), _OUT_SQL), "lm-rare", large_cells=True)

    p = net.initial(voc.share, voc.start)
    work = cells.select("spelled", "places", "docs")
    for _ in range(EPOCHS if docs else 0):
        upto = 0
        for share, rate in zip(TURNS, RATES):
            local = work.mapInArrow(_train(p, voc, rate, (upto, upto + share)), _AVERAGE_SQL)
            shards = local.rdd.getNumPartitions()
            if shards > 64:
                local = local.repartition(math.isqrt(shards), "shard").mapInArrow(_average, _AVERAGE_SQL)
            vectors = sorted(local.collect(), key=lambda r: r.shard)
            weight = sum(r.n for r in vectors)
            if vectors:
                p = net.restore(sum(np.frombuffer(r.cell, np.float32).astype(np.float64) * (r.n / weight) for r in vectors))
            upto += share
    return p, voc, heavy[o], heavy_n[o], int(of_words.sum()) + (docs > 0), rare


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in b.column(0):
            who, v = unpack(c.as_buffer())
            off = pa.array(np.arange(len(who) + 1) * 2 * SIGNS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int64)), pa.ListArray.from_arrays(off, pa.array(v.astype(np.int64)))], names=["id", "v"])


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """One row per document: base and model log10 probabilities."""
    ship(df.sparkSession)
    path = tokenizer or default_path()
    from tokenizers import Tokenizer

    odd = Tokenizer.from_file(path).get_vocab_size()  # the id of words without ids
    end = odd + 1
    n = fan_out(df)
    ident = F.col(f"`{id_col}`").cast("long")
    crc = F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    key = F.xxhash64(F.coalesce(ident, F.lit(-(1 << 63))), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    base = df.select(key.alias("key"), ident.alias("id"), (crc % 7 != 2).alias("train"), F.col(f"`{text_col}`").alias("text"))
    cells = materialize(base.mapInArrow(_encode(path, odd), _CELL_SQL), "lm-cells", large_cells=True)
    p, voc, heavy, heavy_n, kinds, rare = learn(cells, n, end)
    norm = math.log10(voc.tokens + kinds + 1)
    more = np.zeros(len(heavy))
    if rare is not None:
        got = rare.mapInArrow(_of_heavy(heavy), "h long, x double").groupBy("h").agg(F.sum("x").alias("x")).toArrow()
        more = _added(heavy, [(got.column("h").to_numpy().view(np.uint64), got.column("x").to_numpy())])
    scored = cells.mapInArrow(_score(n, p, voc, heavy, heavy_n, more), _OUT_SQL)
    if rare is not None:
        scored = scored.unionAll(rare)
    summed = scored.repartitionById(n, F.col("part")).mapInArrow(_reduce_tail(n, voc), _OUT_SQL)
    return summed.repartitionById(n, F.col("part")).mapInArrow(_finish(voc.tokens, voc.docs, norm), _RESULT_SQL)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    return score_documents(table(spark, sf_dir, "documents"))
