"""Packing by Karmarkar-Karp multiway differencing.

Every text becomes subword ids and a closing id.  Whole windows are cut off its
front; what is left is cut into parts of at most ``part`` ids.  A task collects
parts until they would fill ``group`` windows, then differences them: each part
starts as a partial partition with one non-empty window; the two partial
partitions with the largest spreads are merged, the fullest windows of one on
the emptiest of the other, until one is left.  Its windows are near-equal.  If
one exceeds the capacity, the parts are partitioned again into one window more.

No shuffle: groups form within input partitions, and a window's number is made
of the partition's and a count, so a task that is run again gives the same
numbers.  At most one group a partition is not full.

A null text is empty: its only id is the closing one.  Rows with equal ids are
packed one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_buffers
from .words import default_path, encoder, slices

WINDOW = 2048
END_ID = 1
PART = 512
GROUP = 128
SLACK = 12


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in k groups of near-equal sums.

    Ties go to the smaller index, so the result is a function of the input.
    """
    empty = [()] * (k - 1)
    zeros = [0] * (k - 1)
    heap = [(-s, i, [s, *zeros], [(i,), *empty]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, _, a, bins_a = heapq.heappop(heap)
        _, _, b, bins_b = heapq.heappop(heap)
        merged = [x + y for x, y in zip(a, reversed(b))]  # a falls, b reversed rises
        bins = [(p, q) if p and q else p or q for p, q in zip(bins_a, reversed(bins_b))]
        order = sorted(range(k), key=merged.__getitem__, reverse=True)
        merged = [merged[i] for i in order]
        heapq.heappush(heap, (merged[-1] - merged[0], at, merged, [bins[i] for i in order]))
        at += 1
    return [sorted(_leaves(b)) for b in heap[0][3]] if heap else [[] for _ in range(k)]


def _leaves(tree) -> Iterator[int]:
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            yield x
        else:
            stack.extend(x)


def partition(sizes: list[int], capacity: int, least: int) -> list[list[int]]:
    """Windows within the capacity; their number rises until all fit."""
    k = max(1, least)
    while True:
        bins = [b for b in difference(sizes, k) if b]
        if all(sum(sizes[i] for i in b) <= capacity for b in bins):
            return bins
        k += 1


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(n: int, window: int, part: int) -> list[int]:
    """Starts of a text's pieces: whole windows, then parts, the last one short.

    Differencing evens the windows out with the short last parts.
    """
    whole = n // window * window
    return list(range(0, whole, window)) + list(range(whole, n, part))


def _pack(path: str, window: int, end: int, part: int, group: int, slack: int, keep_ids: bool):
    schema = pa.schema(_FIELDS + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        open_parts: list[tuple] = []
        open_size = 0
        goal = group * (window - slack)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        def close() -> None:
            nonlocal next_id, open_size
            sizes = [p[2] for p in open_parts]
            for b in partition(sizes, window, -(-open_size // window)):
                at = 0
                for i in b:
                    p = open_parts[i]
                    rows.append((*p[:5], next_id, at, *p[5:]))
                    at += p[2]
                next_id += 1
            open_parts.clear()
            open_size = 0

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = text_buffers(batch.column(1))
            for i, j, texts in slices(data, off):
                flat, tok_off = enc.encode(texts, end)
                wide = flat.astype("<u4")
                for d, s, e in zip(ids[i:j], tok_off[:-1].tolist(), tok_off[1:].tolist()):
                    n = e - s
                    cuts = cut_points(n, window, part)
                    for a, z in zip(cuts, [*cuts[1:], n]):
                        body = wide[s + a : s + z]
                        piece = (d, a, z - a, zlib.crc32(body), n) + ((body.astype(np.int32),) if keep_ids else ())
                        if z - a == window:
                            rows.append((*piece[:5], next_id, 0, *piece[5:]))
                            next_id += 1
                            continue
                        if open_size + z - a > goal and open_parts:
                            close()
                        open_parts.append(piece)
                        open_size += z - a
                if len(rows) > 20_000:
                    yield emit()
        if open_parts:
            close()
        if rows:
            yield emit()

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, part: int = PART, group: int = GROUP, slack: int = SLACK, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents and their places in windows of ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``keep_ids``, the piece's ids.  The tokenizer (a ``tokenizers``
    JSON file that splits at white space and drops it) is a parameter.
    ``slack`` is what each window may lack before a group is closed.
    """
    ship(df.sparkSession)
    path = tokenizer or default_path()
    base = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return base.mapInArrow(_pack(path, window, end_id, part, group, slack, keep_ids), PIECES + (", ids array<int>" if keep_ids else ""))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
