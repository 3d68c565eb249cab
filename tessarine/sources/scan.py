"""Listing a source tree, ignore rules, and the chunking job.

Paths are listed on the driver (Spark's file sources skip names that start with
an underscore); the executors read and parse the files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..runtime import ship
from .chunk import FIELDS, SCHEMA

EXCLUDED_DIRS = frozenset("Debug Pods Release __pycache__ bin build cdk.out coverage dist env node_modules obj out site-packages target vendor venv".split())
LOCK_FILES = frozenset("Cargo.lock Gemfile.lock Pipfile.lock bun.lockb composer.lock flake.lock go.sum mix.lock npm-shrinkwrap.json package-lock.json packages.lock.json paket.lock pnpm-lock.yaml poetry.lock uv.lock yarn.lock".split())
BINARY_EXTS = frozenset(".png .jpg .jpeg .gif .bmp .ico .webp .tiff .pdf .zip .gz .tar .bz2 .xz .7z .rar .jar .war .class .o .a .so .dylib .dll .exe .wasm .bin .dat .db .sqlite .sqlite3 .pyc .pyo .pyd .whl .egg .mp3 .mp4 .avi .mov .wav .flac .ogg .webm .ttf .otf .woff .woff2 .eot .lock .sum .map .parquet .npy .npz .pkl .pt .onnx .safetensors .doc .docx .xls .xlsx .ppt .pptx".split())
MAX_BYTES = 1_500_000
IGNORE_FILES = (".gitignore", ".tessarineignore")


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """(regex for paths relative to the rule's folder, directories only?)."""
    only_dirs = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            out, i = out + pattern[i : j + 1], j + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "(?:/.*)?$", only_dirs


class Ignore:
    """Rules of nested ignore files; the last that matches decides."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def load(self, base: str, folder: str) -> None:
        for name in IGNORE_FILES:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    text = f.read()
            except OSError:
                continue
            for line in text.splitlines():
                rule = line.strip()
                if not rule or rule.startswith("#"):
                    continue
                negate = rule.startswith("!")
                rx, only_dirs = pattern_regex(rule.lstrip("!"))
                self.rules.append((base, re.compile(rx), only_dirs, negate))

    def matches(self, path: str, is_dir: bool) -> bool:
        hit = False
        for base, rx, only_dirs, negate in self.rules:
            if only_dirs and not is_dir or base and not path.startswith(base + "/"):
                continue
            if rx.match(path[len(base) + 1 :] if base else path):
                hit = not negate
        return hit


def list_files(root: str, extensions=None, report: dict | None = None, respect_ignore: bool = True) -> Iterator[tuple[str, str]]:
    """(relative, absolute) paths in sorted order; counts what is left out."""
    count = report if report is not None else {}

    def bump(key: str) -> None:
        count[key] = count.get(key, 0) + 1

    ignore = Ignore()
    for folder, dirs, names in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base
        if respect_ignore:
            ignore.load(base, folder)
        keep = []
        for d in sorted(dirs):
            rel = f"{base}/{d}" if base else d
            if d in EXCLUDED_DIRS or d.startswith("."):
                bump("excluded_dirs")
            elif respect_ignore and ignore.matches(rel, True):
                bump("gitignored_dirs")
            else:
                keep.append(d)
        dirs[:] = keep
        for n in sorted(names):
            rel = f"{base}/{n}" if base else n
            if n.startswith("."):
                bump("dotfiles")
            elif extensions and os.path.splitext(n)[1] not in extensions:
                continue
            elif n in LOCK_FILES:
                bump("generated_files")
            elif respect_ignore and ignore.matches(rel, False):
                bump("gitignored_files")
            else:
                yield rel, os.path.join(folder, n)


def files_frame(spark: SparkSession, root: str, report: dict | None = None) -> DataFrame:
    """(ord, path, abs_path, ext, mtime, size) of a tree."""
    rows = []
    for i, (rel, full) in enumerate(list_files(root, report=report)):
        s = os.stat(full)
        rows.append((i, rel, full, os.path.splitext(rel)[1].lower(), s.st_mtime, s.st_size))
    return spark.createDataFrame(rows, "ord long, path string, abs_path string, ext string, mtime double, size long")


_STATUS = "status string, path string, hash string, " + SCHEMA


def parse_files(files: DataFrame) -> DataFrame:
    """A row per chunk and one without chunk fields per file, with its status."""
    ship(files.sparkSession)
    named = F.when(F.col("ext").isin(*BINARY_EXTS) | F.col("path").rlike(r"\.min\.(js|css)$"), "skipped_binary").when(F.col("size") > MAX_BYTES, "skipped_too_large")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from .route import parse_file

        for b in batches:
            rows = []
            for order, path, full, early in zip(b.ord, b.path, b.abs_path, b.early):
                digest, chunks, status = None, [], early
                if not isinstance(early, str):
                    try:
                        with open(full, "rb") as f:
                            text = f.read().decode("utf-8", "replace")
                        digest = hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()
                        status, chunks = parse_file(path, text)
                    except OSError:
                        status = "skipped_unreadable"
                rows.append((status, path, digest, None, *[None] * len(FIELDS)))
                rows += [(None, path, digest, (order << 20) + k, *(c[f] for f in FIELDS)) for k, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["status", "path", "hash", "chunk_ord", *FIELDS]).astype({"chunk_ord": "Int64", "start_line": "Int32", "end_line": "Int32"})

    parts = max(1, min(10_000, files.count() // 64 + 1))
    return files.withColumn("early", named).select("ord", "path", "abs_path", "early").repartition(parts, "path").mapInPandas(run, _STATUS)


def chunks_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("chunk_id is not null").drop("status", "path", "hash")


def index_report(parsed: DataFrame) -> dict[str, int]:
    got = {r.status: r["count"] for r in parsed.where("status is not null").groupBy("status").count().collect()}
    return {"considered": sum(got.values())} | got


#: characters of chunks that a worker holds before it hands them on
HELD_CHARS = 4_000_000


def _chunked(suffix: str, kinds: pa.Schema):
    """(id, text) -> the named fields of all chunks, HELD_CHARS and a text's chunks at most in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .route import parse_text

        names = kinds.names[1:]
        cols, held = [[] for _ in kinds], 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                chunks = parse_text(f"{i.as_py()}{suffix}", text.as_py() or "")
                cols[0] += range(len(chunks))
                for col, f in zip(cols[1:], names):
                    col += [c[f] for c in chunks]
                held += 200 * len(chunks) + (sum(len(c["source"]) for c in chunks) if "source" in names else 0)
                if held > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds)], schema=kinds)
                    cols, held = [[] for _ in kinds], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds)], schema=kinds)

    return run


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, suffix: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Every text of a table chunked as a file of one extension; the guards of a source tree don't apply.

    Only the ``fields`` asked for leave the workers, a few texts' chunks at a time.
    """
    ship(docs.sparkSession)
    schema = StructType([f for f in _parse_datatype_string(SCHEMA) if f.name == "chunk_ord" or f.name in fields])
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_chunked(suffix, to_arrow_schema(schema)), schema)
