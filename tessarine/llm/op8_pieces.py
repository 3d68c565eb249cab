"""SentencePiece encoding and decoding as weighted transducers.

Three transducers are compiled from a model file (read without any library):
the normaliser (dummy prefix, spaces to U+2581), the lexicon (a trie of pieces,
each arc path weighing minus the piece's score) and the byte fallback (a
character that no piece ends with costs its UTF-8 bytes).

In a unigram model the cheapest path is the encoding: the composition with a
text is searched position by position in the tropical semiring.  In a BPE model
it isn't: merges go by rank, not by sums.  There the lexicon is composed with
one transducer more, which lets piece b follow piece a only if merging a + b
gives back a, b.  A sequence all of whose neighbours pass is the merge result,
so one path is left, whatever it weighs: it is searched from the front, the
longest piece first, and no place is left twice with the same piece.  Tests
hold the ids against the public library's.

Texts are cut where no piece can span (before a space that follows a letter,
around characters of no piece), and each different unit is searched once per
worker; the memory is a cache that nothing depends on.

A null text is empty and has no ids.  An empty table gives an empty result.
Decoding gives the text back, but for U+2581, which comes back as a space, as
in the public library.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, table, text_buffers, text_slices
from .words import _Grown, _Numbered, default_path

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS = 800_000
CACHE_PAIRS = 1_500_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.bpe, self.prefix, self.squeeze, rules = False, True, True, b""
        for field, value in _fields(raw):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(d.get(3, NORMAL))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                d = dict(_fields(value))
                self.prefix, self.squeeze, rules = bool(d.get(3, 1)), bool(d.get(4, 1)), d.get(2, b"")
        if rules or self.squeeze:
            raise ValueError("only the identity normaliser is supported")


class Transducer:
    """Normaliser, lexicon, byte fallback and, for BPE, the neighbour filter."""

    def __init__(self, path: str):
        m = Model(path)
        self.model = m
        self.index = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER)}
        self.score = {p: m.scores[i] for p, i in self.index.items()}
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        self.byte = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        # the lexicon, backwards but for BPE: arcs of a trie, final states hold the piece
        self.trie: dict = {}
        for p in self.index:
            node = self.trie
            for c in p if m.bpe else reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        letters = {c for p in self.index for c in p}
        marks = [p for p in self.index if MARK in p[1:] and p.strip(MARK)]
        self.units = re.compile(r"(?s).+" if marks else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in letters else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        body = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.out_size = np.array([len(b) for b in body], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(body), np.uint8)

    def normalise(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.model.prefix else text

    def merged(self, text: str) -> list[str]:
        """The merge result of a short string, by the definition."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = self.score.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def may_follow(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def shortest(self, unit: str) -> list[str]:
        """Pieces (and characters without one) on the cheapest path through a unit."""
        if self.model.bpe:
            return self._only(unit)
        score, trie = self.score, self.trie
        states: list[tuple[float, str]] = [(0.0, "")]
        for j in range(1, len(unit) + 1):
            best, last = None, ""
            node, i = trie, j
            while i:
                node = node.get(unit[i - 1])
                if node is None:
                    break
                i -= 1
                piece = node.get("")
                if piece is not None:
                    cost = states[i][0] - score[piece]
                    if best is None or cost < best:
                        best, last = cost, piece
            c = unit[j - 1]
            if c not in score:
                cost = states[j - 1][0] + 1e6
                if best is None or cost < best:
                    best, last = cost, c
            states.append((best, last))
        path, j = [], len(unit)
        while j:
            path.append(states[j][1])
            j -= len(path[-1])
        return path[::-1]

    def _only(self, unit: str) -> list[str]:
        """The path all of whose neighbours pass, by depth, the longest piece first.

        ``rest`` holds the pieces not yet tried at each place of the path, ``dead``
        the ends and pieces from which no path leads on.
        """
        trie, pairs, n = self.trie, self.pairs, len(unit)
        path: list[str] = []
        rest: list[list[str]] = []
        dead: set[tuple[int, str]] = set()
        at, last = 0, ""
        while at < n:
            node, i, found = trie, at, []
            while i < n:
                node = node.get(unit[i])
                if node is None:
                    break
                i += 1
                piece = node.get("")
                if piece is not None:
                    found.append(piece)
            if not found or len(found[0]) > 1:
                found.insert(0, unit[at])
            while True:
                while not found:
                    dead.add((at, last))
                    at -= len(path.pop())
                    last = path[-1] if path else ""
                    found = rest.pop()
                piece = found.pop()
                if dead and (at + len(piece), piece) in dead:
                    continue
                if at:
                    got = pairs.get((last, piece))
                    if not (self.may_follow(last, piece) if got is None else got):
                        continue
                break
            path.append(piece)
            rest.append(found)
            at, last = at + len(piece), piece
        return path

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in self.shortest(unit):
            i = self.index.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units.findall(self.normalise(text)) for i in self.unit_ids(u)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What ids stand for, without the dummy prefix."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        got = self.out[np.repeat(self.out_start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return got[1:] if self.model.prefix and got[:1] == b" " else got

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class UnitEncoder:
    """Encodes many texts; each different unit is searched once."""

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        self.fst, self.limit = Transducer(path), limit
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.start, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.limit:
            self._clear()
        find, norm = self.fst.units.findall, self.fst.normalise
        split = [find(norm(t)) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            got = [self.fst.unit_ids(u) for u in fresh]
            size = np.fromiter(map(len, got), np.int32, len(got))
            self.start.add(self.ids.n + np.cumsum(size) - size)
            self.size.add(size)
            self.ids.add(np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())))
        size = self.size.a[numbers].astype(np.int64)
        upto = np.r_[0, np.cumsum(size)]
        flat = self.ids.a[np.repeat(self.start.a[numbers] - upto[:-1], size) + np.arange(int(upto[-1]))]
        return flat, upto[np.r_[0, np.cumsum(counts)]]


_ENCODERS: dict[str, UnitEncoder] = {}


def unit_encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
_OUT_SQL = "doc_id long, n_bytes long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = unit_encoder(path)
        is_byte = np.zeros(len(enc.fst.model.pieces), bool)
        is_byte[list(enc.fst.byte.values())] = True
        for b in batches:
            data, off = text_buffers(b.column(1))
            ids, rows = b.column(0).to_pylist(), []
            for i, j in text_slices(off, 1 << 20):
                raw = [data[s:e].tobytes() for s, e in zip(off[i:j], off[i + 1 : j + 1])]
                flat, at = enc.encode([r.decode() for r in raw])
                for d, r, s, e in zip(ids[i:j], raw, at[:-1].tolist(), at[1:].tolist()):
                    x = flat[s:e]
                    back = enc.fst.decode_bytes(x)
                    rows.append((d, len(r), e - s, int(is_byte[x].sum()), zlib.crc32(x.astype("<u4")), hashlib.sha256(back).hexdigest(), back == r))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return lean(run)


def _encoded(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = unit_encoder(path)
        for b in batches:
            flat, at = enc.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))], names=names)

    return lean(run)


def encode_column(df: DataFrame, text_col: str = "text", out_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """``df`` with the text's ids; an existing column of that name is replaced."""
    ship(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != out_col]
    wide = df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text_col}`").alias("__tsr_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out_col}` array<int>"
    return wide.mapInArrow(_encoded(model or default_path("piece_bpe_32k.model"), [*(f.name for f in keep), out_col]), schema)


def decode_column(df: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text that ids stand for; null ids give null."""
    ship(df.sparkSession)
    path = model or default_path("piece_bpe_32k.model")
    @F.pandas_udf("string")
    def back(s: pd.Series) -> pd.Series:
        fst = unit_encoder(path).fst
        return s.map(lambda x: None if x is None else fst.decode(x))

    return df.withColumn(out_col, back(F.col(f"`{ids_col}`")))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether decoding gives it back."""
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_digests(default_path("piece_bpe_32k.model")), _OUT_SQL)
