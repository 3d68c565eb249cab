"""Shared plumbing of the training-data operators.

* :func:`ship` puts this library on the Python workers.
* :func:`materialize` cuts lineage with a table in the cluster's shared
  checkpoint folder, so that a lost executor costs a re-read, not a re-run.
* :func:`fan_out` sizes shuffles from the optimizer's size estimate, so tasks
  keep their size when the data grows.
* :func:`pack` / :func:`unpack` turn numpy columns into one binary cell, byte
  planes first: a few large cells are shuffled instead of many small rows.
"""

from __future__ import annotations

import atexit
import os
import struct
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, bool] = {}
_MADE: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Add the library to the workers' path, once per application."""
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root.endswith(".zip") or not os.path.isdir(root):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessarine-"), "tessarine_lib.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the setting is missing, and then only
    on a local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessarine-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: for tables of large cells: without these the writer holds 100 rows, and the reader a whole file, however large the cells are
LARGE_CELLS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, name: str, *, large_cells: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessarine/{name}-{uuid.uuid4().hex}"
    df.write.options(**LARGE_CELLS if large_cells else {}).parquet(path)
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, prefix: str = "") -> None:
    """Delete the tables that :func:`materialize` made under this name."""
    for made in [m for m in _MADE if f"/tessarine/{prefix}" in m[1]]:
        _delete(*made)
        _MADE.remove(made)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            if path.startswith("file:"):
                import shutil

                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        except OSError:
            pass


def fan_out(df: DataFrame, bytes_each: int = 48 << 20, least: int = 1) -> int:
    """Partitions for a shuffle of about the size of ``df``.

    The session's ``spark.sql.shuffle.partitions`` is the floor; above it the
    optimizer's size estimate decides, so that a task's share stays the same at
    every input size.
    """
    spark = df.sparkSession
    floor = max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown: the estimate of a product
        return floor
    return max(floor, min(1_000_000, -(-size // bytes_each)))


def pack(*cols: np.ndarray) -> bytes:
    """Columns as one binary cell; byte planes, which block compressors like."""
    out = [struct.pack("<B", len(cols))]
    for c in cols:
        c = np.ascontiguousarray(c)
        out.append(struct.pack("<2sQ", c.dtype.str[1:].encode(), len(c)))
    for c in cols:
        c = np.ascontiguousarray(c)
        out.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return b"".join(out)


def unpack(cell) -> list[np.ndarray]:
    buf = memoryview(cell)
    (n,), at, heads, cols = struct.unpack_from("<B", buf, 0), 1, [], []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", buf, at)
        heads.append((np.dtype(kind.decode()), size))
        at += 10
    for kind, size in heads:
        raw = np.frombuffer(buf, np.uint8, size * kind.itemsize, at)
        cols.append(np.ascontiguousarray(raw.reshape(kind.itemsize, size).T).view(kind).reshape(size))
        at += size * kind.itemsize
    return cols


def join_packed(cells) -> list[np.ndarray]:
    """Concatenate the columns of many packed cells."""
    parts = [unpack(c) for c in cells]
    return [np.concatenate(c) for c in zip(*parts)] if parts else []


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spread(n: int, *cols):
    """Partition number 0..n-1 from a JVM hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Partition number from the top 32 bits of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(sorted_col: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if len(sorted_col) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_col[1:] != sorted_col[:-1]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LEAN: list = []


def _tune() -> None:
    if _LEAN:
        return
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD: arrays that come and go keep their pages
        _LEAN.append(libc)
    except (OSError, AttributeError):
        _LEAN.append(None)


def lean(f):
    """Wrap a worker generator so that memory it freed goes back to the system.

    Large blocks are mapped one by one from the start, and what the allocators
    still hold is returned when the task ends: idle workers stay small.
    """

    def run(batches):
        _tune()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _LEAN and _LEAN[0] is not None:
        _LEAN[0].malloc_trim(0)


def text_slices(off: np.ndarray, size: int):
    """Ranges of texts of about ``size`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j
