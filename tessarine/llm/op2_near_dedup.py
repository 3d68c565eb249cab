"""MinHash near-dedup with an LSH forest.

Documents are sets of two-word shingles; two are linked if their Jaccard
similarity is at least 3/4, confirmed on the full sets.

1. Map: shingle every whole text; documents of one task with equal sets keep
   one representative (the smallest id).  A signature of ``PERMS`` minima gives
   ``TREES`` signature orders; order t starts with components DEPTH * t and
   goes on from there.
2. Reduce, by order and first components: sort by the following components
   (the longest common prefixes are then neighbours).  Neighbours are
   candidates.  The depth adapts: where a region holds more than ``DENSE``
   documents, neighbours must share deeper prefixes or lie within ``NEAR``
   places.  A 128-bit sketch of the signature drops pairs that are far below
   the threshold.
3. Candidates' connected components are *regions*.  A region's texts meet in
   one task, which finds the links within it exactly, on full sets, by a
   breadth-first search over the documents not yet reached.  Regions of more
   than ``REGION`` documents are cut into blocks and every two blocks meet.
4. Links' connected components give each document's smallest reachable id.

A pair at the threshold is missed by all 40 orders of depth 4 with a chance of
2.5e-7.

Nulls: a null text is an empty set, linked with nothing; a row with a null id
is returned with a null component and counts as kept.  Rows that share an id
are one document for linking.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, fan_out, lean, materialize, mix64, pack, runs, ship, table, text_buffers, text_slices, unpack
from .components import connected_components
from .shingles import shingle_sets

PERMS, DEPTH = 160, 4
TREES = PERMS // DEPTH
DENSE, NEAR = 32, 6
SKETCH_MIN = 90
REGION = 12_000
SLICE = 2 << 20
NUM, DEN = 75, 100

_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
_OUT_SQL = "part int, kind tinyint, payload binary"
_INFO, _ENTRY, _EDGE = 0, 1, 2


def _family():
    r = np.random.default_rng(160)
    return r.integers(0, 2**32, PERMS, dtype=np.uint32), r.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, PERMS) minima; rows of empty sets are all ones."""
    xor, mul = _family()
    n = len(off) - 1
    out = np.full((n, PERMS), 0xFFFFFFFF, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    step = 2048
    for i in range(0, len(x), step):
        part = x[i : i + step, None] ^ xor
        part *= mul
        d = doc[i : i + step]
        s = runs(d)
        low = np.minimum.reduceat(part, s, axis=0)
        np.minimum(out[d[s]], low, out=low)
        out[d[s]] = low
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """(documents, 2) words: one bit of each of the first 128 components."""
    bits = (sig[:, :128] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def forest_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each order: a hash of its first components; the next four, 16 bits each."""
    n = len(sig)
    wide = sig.astype(np.uint64)
    lead = np.zeros((n, TREES), np.uint64)
    deep = np.zeros((n, TREES), np.uint64)
    first = np.arange(TREES) * DEPTH
    for i in range(DEPTH):
        lead = mix64(lead * np.uint64(0x9E3779B97F4A7C15) + wide[:, first + i])
        deep = (deep << np.uint64(16)) | (mix64(wide[:, (first + DEPTH + i) % PERMS]) & np.uint64(0xFFFF))
    return mix64(lead ^ mix64(np.arange(1, TREES + 1, dtype=np.uint64))), deep


def _map(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            data, off = text_buffers(b.column(1))
            for i, j in text_slices(off, SLICE * 4):
                yield from _emit(one(ids[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i]))

    def one(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, bytes]]:
        sets, at = [], [0]
        for i, j in text_slices(off, SLICE):
            s, o = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sets.append(s)
            at.extend((o[1:] + at[-1]).tolist())
        sets, at = np.concatenate(sets), np.array(at)
        size = np.diff(at)
        sums = np.r_[np.uint64(0), np.cumsum(mix64(sets))]
        whole = mix64(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
        # equal sets: the smallest id stands for all
        o = np.lexsort((ids, whole))
        lead = np.maximum.accumulate(np.where(np.r_[True, whole[o][1:] != whole[o][:-1]], np.arange(len(o)), 0))
        rep = ids.copy()
        rep[o] = ids[o][lead]
        rep[size == 0] = ids[size == 0]
        rows = [(int(ids[0] % n_parts), _INFO, pack(ids, size, rep))]
        pick = np.unique(o[lead])
        pick = pick[size[pick] > 0]
        if not len(pick):
            return rows
        take = np.repeat(at[pick] - (np.cumsum(size[pick]) - size[pick]), size[pick]) + np.arange(size[pick].sum())
        sig = signatures(sets[take], np.r_[0, np.cumsum(size[pick])])
        sk = sketches(sig)
        lead, deep = forest_keys(sig)
        who = np.repeat(pick, TREES)
        lead, deep, sk = lead.ravel(), deep.ravel(), np.repeat(sk, TREES, axis=0)
        part = bucket_of(lead, n_parts)
        o = np.argsort(part, kind="stable")
        cut = np.r_[runs(part[o]), len(o)]
        for s, e in zip(cut[:-1], cut[1:]):
            x = o[s:e]
            rows.append((int(part[x[0]]), _ENTRY, pack(lead[x], deep[x], sk[x, 0], sk[x, 1], ids[who[x]])))
        return rows

    return lean(run)


def _emit(rows) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _OUT)], schema=_OUT)


def neighbours(lead: np.ndarray, deep: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (places) among entries sorted by (lead, deep).

    Small regions give all their pairs within reach; in dense regions each
    entry meets the NEAR next ones, which share the longest prefixes with it.
    """
    size = np.diff(np.r_[runs(lead), len(lead)])
    reach = np.repeat(np.where(size <= DENSE, size, NEAR), size)
    left, right = [], []
    for step in range(1, int(reach.max()) + 1 if len(reach) else 1):
        i = np.flatnonzero((reach[:-step] > step - (reach[:-step] == NEAR)) & (lead[step:] == lead[:-step]))
        if len(i):
            left.append(i)
            right.append(i + step)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    alike = 128 - np.bitwise_count(a[i] ^ a[j]).astype(np.int64) - np.bitwise_count(b[i] ^ b[j])
    good = alike >= SKETCH_MIN
    return i[good], j[good]


def _reduce():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            kind = b.column(1).to_numpy()
            held += [unpack(b.column(2)[int(i)].as_buffer()) for i in np.flatnonzero(kind == _ENTRY)]
            info = b.filter(pa.array(kind == _INFO))
            if info.num_rows:
                yield info
        if not held:
            return
        lead, deep, a, b_, ids = (np.concatenate(c) for c in zip(*held))
        held.clear()
        o = np.argsort(lead)
        s = runs(lead[o])
        size = np.diff(np.r_[s, len(o)])
        o = o[np.repeat(size > 1, size)]
        o = o[np.lexsort((ids[o], deep[o], lead[o]))]
        lead, deep, a, b_, ids = (c[o] for c in (lead, deep, a, b_, ids))
        i, j = neighbours(lead, deep, a, b_)
        # a forest of the candidate pairs says as much as all of them
        u, v = spanning(ids[i], ids[j])
        if len(u):
            yield from _emit([(0, _EDGE, pack(u, v))])

    return lean(run)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) of the components of the pairs."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    out = root != np.arange(len(nodes))
    return nodes[out], nodes[root[out]]


def _explode(kind: int, names: list[str]):
    """Packed cells of one kind as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                cols = unpack(c.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    return lean(run)


def linked(sets: np.ndarray, off: np.ndarray, ids: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of ids) that connect all that true links connect.

    Breadth-first: an expanded document meets every document not yet reached.
    With ``split``, only pairs of a document before and one from that place on
    count.
    """
    n = len(ids)
    size = np.diff(off)
    vocab, flat = np.unique(sets, return_inverse=True)
    mark = np.zeros(len(vocab), bool)
    left, right = [], []

    def near(x: int, others: np.ndarray) -> np.ndarray:
        lo, hi = size[x] * NUM, size[x] * DEN
        others = others[(size[others] * DEN >= lo) & (size[others] * NUM <= hi)]
        if not len(others):
            return others
        mark[flat[off[x] : off[x + 1]]] = True
        n_others = size[others]
        ends = np.cumsum(n_others)
        hits = mark[flat[np.repeat(off[others] - (ends - n_others), n_others) + np.arange(ends[-1])]]
        common = np.add.reduceat(hits.astype(np.int64), ends - n_others)
        mark[flat[off[x] : off[x + 1]]] = False
        return others[DEN * common >= NUM * (size[x] + n_others - common)]

    if split is not None:
        for x in range(split):
            got = near(x, np.arange(split, n))
            left.append(np.full(len(got), ids[x]))
            right.append(ids[got])
        return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])
    alive = np.ones(n, bool)
    alive[size == 0] = False
    for start in range(n):
        if not alive[start]:
            continue
        alive[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            others = np.flatnonzero(alive)
            if not len(others):
                break
            got = near(x, others)
            alive[got] = False
            queue.extend(got.tolist())
            left.append(np.full(len(got), ids[x]))
            right.append(ids[got])
    return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])


def _links():
    """Rows (task, side, id, text) -> links; a task is a region or two blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            task, side, ids = (b.column(i).to_numpy() for i in range(3))
            data, off = text_buffers(b.column(3))
            for i, j in text_slices(off, SLICE):
                parts.append((task[i:j], side[i:j], ids[i:j], *shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])))
        if not parts:
            return
        task, side, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        sets = np.concatenate([p[3] for p in parts])
        size = np.concatenate([np.diff(p[4]) for p in parts])
        parts.clear()
        at = np.cumsum(size) - size
        o = np.lexsort((ids, side, task))
        cut = np.r_[runs(task[o]), len(o)]
        for s, e in zip(cut[:-1], cut[1:]):
            x = o[s:e]
            n = size[x]
            ends = np.cumsum(n)
            body = sets[np.repeat(at[x] - (ends - n), n) + np.arange(ends[-1])]
            split = int((side[x] == 0).sum())
            a, b = linked(body, np.r_[0, ends], ids[x], split if split < len(x) else None)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return lean(run)


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, region: int = REGION) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    ship(spark)
    n = fan_out(df)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    named = base.where("id is not null")
    found = named.mapInArrow(_map(n), _OUT_SQL).repartitionById(n, F.col("part")).mapInArrow(_reduce(), _OUT_SQL)
    found = materialize(found, "forest")
    info = found.where(F.col("kind") == _INFO).select("payload").mapInArrow(_explode(_INFO, ["id", "n", "rep"]), "id long, n long, rep long")
    edges = found.where(F.col("kind") == _EDGE).select("payload").mapInArrow(_explode(_EDGE, ["a", "b"]), "a long, b long")
    regions = materialize(connected_components(edges), "regions")

    # regions beyond the bound are cut into blocks; every two blocks meet
    big = regions.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > region)
    blocks = F.ceil(F.col("size") / (region // 2)).cast("int")
    tasks = regions.join(big, "root", "left").select(
        "node", "root", F.when(F.col("size").isNotNull(), blocks).alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    alone = tasks.where("blocks is null").select("node", F.col("root").alias("task"), F.lit(0).alias("side"))
    meets = (
        tasks.where("blocks is not null")
        .select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    jobs = alone.unionByName(meets)
    rows = named.join(jobs.hint("shuffle_hash"), F.col("id") == F.col("node")).select("task", "side", "id", "text")
    links = rows.repartition(n, "task").mapInArrow(_links(), "a long, b long")
    roots = materialize(connected_components(links), "roots")
    got = info.join(roots, F.col("rep") == F.col("node"), "left")
    # a component's smallest id is its smallest representative's
    comp = F.coalesce("root", "rep")
    got = got.select("id", "n", comp.alias("component"))
    unnamed = base.where("id is null").select("id", F.col("text")).mapInArrow(_count(), "id long, n long").withColumn("component", F.lit(None).cast("long"))
    return got.unionByName(unnamed).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(shingle_sets(data, off)[1]))], names=["id", "n"])

    return run


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_components(table(spark, sf_dir, "documents"))
