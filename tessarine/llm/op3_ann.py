"""Nearest neighbours by collision-counting hashing.

A hash is one random projection; its index is the array of a block's vectors
sorted by it.  A query opens a window centred at its own projection in every
array and widens all windows by the factor GROWTH (virtual rehashing: the same
arrays serve every radius).  A vector that has been in at least ALPHA of the
windows is verified: its exact distance is computed.  A query is done when its
windows are so wide that a vector at the distance of its k-th neighbour found
so far is in enough of them but for a chance of about 1 %, or when they span
all arrays.

Vectors are cut into blocks of about BLOCK by a hash.  Queries go to the blocks:
a task sorts its rows by block, vectors first, builds a block's index once and
streams the queries through it, so it holds one block and one batch of queries.
Each block gives each query's k best, which are merged by a window.  Nothing is
broadcast, sampled or capped.

Null, zero and non-finite vectors, vectors with null components, and rows with
a null id take no part.  Vectors of different lengths never meet.  Queries of one
id and vector are one query; it leaves out one row of its own id and vector, and
meets all others, also those of its id.  Repeated rows are several candidates;
ties go to the smaller id.  Other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table

PROJECTIONS = 24
ALPHA = 0.5
GROWTH = 1.4
BLOCK = 16384
SEED = 3


class SortedProjections:
    """A block's vectors, sorted along each random projection."""

    def __init__(self, x: np.ndarray, m: int = PROJECTIONS, seed: int = SEED):
        self.x = x
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], m))
        p = x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.m = m
        self.need = max(1, math.ceil(ALPHA * m))
        # the half-width, in distances, at which a vector is in `need` windows but for 1 %
        share = min(0.995, ALPHA + 2.4 * math.sqrt(ALPHA * (1 - ALPHA) / m))
        self.reach = NormalDist().inv_cdf((1 + share) / 2)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest to q but rows marked own; ties to smaller ids."""
        n = len(self.x)
        k = min(k, n - int(own.sum()))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        centre = q @ self.a
        at = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        lo, hi = at.copy(), at.copy()
        count = np.zeros(n, np.int16)
        done = own.copy()
        found, dist = np.zeros(0, np.int64), np.zeros(0)
        # first windows: as wide as the k nearest of each array
        near = [np.abs(self.values[j, max(0, at[j] - k) : at[j] + k] - centre[j]) for j in range(self.m)]
        h = max(float(np.median([d[min(k, len(d)) - 1 :].min() if len(d) else 0.0 for d in map(np.sort, near)])), 1e-12)
        while True:
            fresh = []
            for j in range(self.m):
                v = self.values[j]
                a, b = np.searchsorted(v, centre[j] - h, "left"), np.searchsorted(v, centre[j] + h, "right")
                a, b = min(a, lo[j]), max(b, hi[j])
                fresh += [self.order[j, a : lo[j]], self.order[j, hi[j] : b]]
                lo[j], hi[j] = a, b
            count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
            pick = np.flatnonzero((count >= self.need) & ~done)
            if len(pick):
                done[pick] = True
                found = np.concatenate([found, pick])
                gap = self.x[pick] - q
                dist = np.concatenate([dist, np.sqrt((gap * gap).sum(axis=1))])
                if len(found) > k:
                    best = np.lexsort((ids[found], dist))[:k]
                    found, dist = found[best], dist[best]
            if len(found) >= k and h >= self.reach * dist.max():
                break
            if (hi - lo).min() == n:
                break
            h *= GROWTH
            if len(found) >= k:  # no wider than the last window has to be
                h = min(h, max(h / GROWTH, self.reach * float(dist.max())) * (1 + 1e-12))
        best = np.lexsort((ids[found], dist))[:k]
        return found[best], dist[best]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("key", pa.int64())])


def _vectors(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _search(k: int):
    """Rows (dim, block, query?, id, vector), sorted in this order -> the k nearest of each query in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = None, [], None
        for b in batches:
            dim, block, asks, ids = (np.asarray(b.column(i)).astype(np.int64) for i in range(4))
            cut = np.r_[np.flatnonzero(np.r_[True, (np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)]) if b.num_rows else [], b.num_rows].astype(int)
            for s, e in zip(cut[:-1], cut[1:]):
                if here != (dim[s], block[s]):
                    here, held, index = (dim[s], block[s]), [], None
                part = b.slice(s, e - s)
                own, x = ids[s:e], _vectors(part.column(4))
                if not asks[s]:
                    held.append((own, x))
                    continue
                if index is None:
                    all_ids, all_x = (np.concatenate(c) for c in zip(*held)) if held else (own[:0], x[:0])
                    o = np.argsort(all_ids, kind="stable")  # the result doesn't hang on the order they came in
                    held, index = [(all_ids[o], all_x[o])], SortedProjections(all_x[o]) if len(o) else None
                if index is not None:
                    yield from found(own, x, part.column(5), held[0][0], index)

    def found(qids, q, keys, ids, index):
        out = [[], [], [], []]
        for i, v, key in zip(qids, q, keys.to_pylist()):
            mine = np.zeros(len(ids), bool)
            same = np.flatnonzero(ids == i)
            same = same[(index.x[same] == v).all(axis=1)]
            mine[same[:1]] = True
            place, dist = index.search(v, mine, k, ids)
            for c, x in zip(out, (np.full(len(place), i), ids[place], dist, np.full(len(place), key))):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_OUT)

    return run


def usable(v):
    """A vector that can be searched: no null, no non-finite number, not zero."""
    x = v.cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(x, lambda e: e != 0)


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, *, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of ``df`` for each row of ``queries``."""
    ship(df.sparkSession)

    def clean(d):
        v = F.col(f"`{vector_col}`")
        return d.where(F.col(f"`{id_col}`").isNotNull() & usable(v)).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))

    blocks = max(1, -(-df.count() // block))
    data = clean(df).select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("d"), F.lit(0).alias("asks"), "id", "v", F.lit(0).cast("long").alias("key"))
    asked = clean(queries).dropDuplicates(["id", "v"])
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("d"), F.lit(1).alias("asks"), "id", "v", F.xxhash64("v").alias("key"))
    tasks = max(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = data.unionByName(asked).repartition(tasks, "dim", "d").sortWithinPartitions("dim", "d", "asks")
    got = rows.mapInArrow(_search(k), "query_id long, vec_id long, score double, key long")
    w = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth."""
    df = table(spark, sf_dir, "embeddings")
    return nearest(df, df.where(F.col("vec_id") % 100 == 0))
