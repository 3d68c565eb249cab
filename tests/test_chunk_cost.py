"""What chunkers and compression hold and look at."""

from __future__ import annotations

import random
import time

import pyarrow as pa

from tessarine.operators import context, slicing
from tessarine.sources import scan
from tessarine.sources.chunk import mask, squeeze, squeezed


def test_chunkers_hold_few_texts_and_only_the_fields_asked_for(spark):
    page = "\n".join(f"<div id=d{i}>{'x' * 200}</div>" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(60)]), pa.array([page] * 60)], names=["id", "text"])
    kinds = pa.schema([("chunk_ord", pa.int64()), ("chunk_id", pa.string()), ("source", pa.string())])
    sizes = [(b.num_rows, b.nbytes) for b in scan._chunked(".html", kinds)(iter([batch]))]
    assert sum(n for n, _ in sizes) == 60 * 2000 and len(sizes) > 5 and max(x for _, x in sizes) < 2 * scan.HELD_CHARS
    df = spark.createDataFrame([(1, "<nav>a</nav>"), (2, None)], "id long, text string")
    got = scan.chunk_texts(df, "id", "text", ".html", ("chunk_id", "name"))
    assert got.columns == ["chunk_ord", "chunk_id", "name"] and [tuple(r) for r in got.collect()] == [(0, "1.html::nav@L1", "nav@L1")]


def slow_mask(src, line_marks, block_marks, quotes):
    """Character by character."""
    out, i = "", 0
    while i < len(src):
        j = i
        if any(src.startswith(m, i) for m in line_marks):
            j = src.find("\n", i) if "\n" in src[i:] else len(src)
        elif p := next((p for p in block_marks if src.startswith(p[0], i)), None):
            j = src.find(p[1], i + len(p[0]))
            j = len(src) if j < 0 else j + len(p[1])
        elif src[i] in quotes:
            j = i + 1
            while j < len(src) and src[j] != src[i] and (src[j] != "\n" or src[i] == "`"):
                j += 2 if src[j] == "\\" else 1
            j = min(len(src), j + (j < len(src) and src[j] == src[i]))
        if j > i:
            out += "".join(c if c == "\n" else " " for c in src[i:j])
        else:
            out, j = out + src[i], i + 1
        i = j
    return out


def test_masks_look_at_marks_alone():
    r = random.Random(2)
    for _ in range(3000):
        src = "".join(r.choices("ab/*#\"'`\\\n -$", k=r.randint(0, 25)))
        for args in ((("//",), (("/*", "*/"),), "\"'`"), (("#",), (), ""), (("--",), (("/*", "*/"), ("$$", "$$")), "'"), ((), (), "")):
            assert mask(src, *args) == slow_mask(src, *args), (src, args)
        assert squeezed(src, 3)[:3] == squeeze(src)[:3] and (len(squeezed(src, 3)) > 2) == (len(squeeze(src)) > 2)
    began = time.process_time()
    mask("plain words " * 400_000)
    assert time.process_time() - began < 1


def test_compression_cuts_each_line_into_tokens_twice_at_most(monkeypatch):
    r = random.Random(4)
    lines = [" ".join(r.choices(["the", "reader", "aB", "x_y", "façade", "= 1", "return", "{", "}", "n"], k=40)) for _ in range(60)]
    calls, plain = [], slicing.tokens

    def counted(text):
        calls.append(text)
        return plain(text)

    monkeypatch.setattr(slicing, "tokens", counted)
    monkeypatch.setattr(context, "tokens", counted)
    got = context.compress("\n".join(lines), "the reader of x", 200, "text")
    assert got["compressed_tokens"] < got["original_tokens"] and len(calls) <= 2 * len(lines) + 1
