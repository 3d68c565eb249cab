from __future__ import annotations

import random

import numpy as np
import pytest

from tessarine.llm import brute
from tessarine.llm import op1_suffix_dedup as op1
from tessarine.llm import op2_near_dedup as op2
from tessarine.llm.components import connected_components

SCHEMA = "doc_id long, text string, __tsr_x string"


def corpus(seed: int = 1) -> dict[int, str | None]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    shared = text(60)
    docs: dict[int, str | None] = {}
    for i in range(0, 400, 2):
        kind = r.random()
        if kind < 0.15 and docs:
            docs[i] = docs[r.choice(list(docs))]
        elif kind < 0.3 and docs:
            base = (docs[r.choice(list(docs))] or "x").split()
            for _ in range(r.randint(1, 6)):
                base[r.randrange(len(base))] = r.choice(words)
            docs[i] = " ".join(base)
        elif kind < 0.5:
            docs[i] = text(r.randint(0, 20)) + " " + shared + " " + text(r.randint(0, 20))
        elif kind < 0.55:
            docs[i] = "again " * r.randint(1, 400)
        else:
            docs[i] = text(r.randint(1, 120))
    docs |= {1: None, 3: "", 5: "é" * 40, 7: "é" * 200, 9: text(30_000), 11: "word", 13: "Word", 401: "\n\t ", 403: "x" * 49}
    return docs


@pytest.mark.parametrize("hot", [2, 256])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op1, "HOT", hot)
    monkeypatch.setattr(op1, "FLUSH", 500)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "y") for i, t in docs.items()], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n, r.m, r.s, r.h) for r in op1.suffix_dedup(df).selectExpr("doc_id", "__tsr_n_bytes n", "__tsr_n_removed m", "__tsr_n_spans s", "__tsr_sha h").collect()}
    assert got == brute.suffix_dedup(docs)


def test_suffix_dedup_long_texts_in_pieces(monkeypatch):
    r = random.Random(2)
    text = bytes(r.choice(b"abcd ") for _ in range(5000))
    off = np.array([0, len(text)])
    data = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(op1, "CHUNK", 700)
    h, v, doc, pos, count = op1.anchors(data, off)
    starts = np.concatenate([np.arange(p, p + c) for p, c in zip(pos, count)])
    assert sorted(starts.tolist()) == list(range(len(text) - 49))  # each string once


def test_string_buckets_are_equal_strings():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)) * 2, np.uint8)
    starts = np.arange(len(data) - 49)
    got = op1.string_buckets(data, starts)
    by: dict = {}
    for s, b in zip(starts, got):
        by.setdefault(data[s : s + 50].tobytes(), set()).add(int(b))
    assert all(len(b) == 1 for b in by.values()) and len({next(iter(b)) for b in by.values()}) == len(by)


def test_suffix_dedup_ids_that_repeat_or_are_null(spark):
    a, b = "a long passage that is at least fifty bytes long, surely so " * 2, "another passage of more than fifty bytes, not like the first " * 2
    df = spark.createDataFrame([(1, a, ""), (1, a, ""), (1, b, ""), (2, b, ""), (None, a, ""), (None, a, "")], SCHEMA)
    got = sorted((r.doc_id or 99, r.n_removed) for r in op1.suffix_dedup(df).selectExpr("doc_id", "__tsr_n_removed n_removed").collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, len(b)), (99, len(a)), (99, len(a))]


def test_suffix_dedup_keeps_columns_and_whole_characters(spark):
    a = "é" * 60
    df = spark.createDataFrame([(1, a, "p"), (2, "x" + a + "ö", "q"), (3, None, None)], SCHEMA)
    got = {r.doc_id: r for r in op1.suffix_dedup(df).collect()}
    assert got[2].text == "x" and got[2]["__tsr_x"] == "q" and got[3].text is None and got[1].text == a


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op1.suffix_dedup(df).count() == 0
    assert op2.near_components(df).count() == 0


def test_near_dedup_is_brute_force(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, "y") for i, t in docs.items()], SCHEMA).repartition(5)
    want = brute.near_dedup(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2.near_components(df).collect()}
    assert got == want
    blocks = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2.near_components(df, region=4).collect()}
    assert blocks == want


def test_near_dedup_nulls(spark):
    df = spark.createDataFrame([(None, "a b c", ""), (None, "a b c", ""), (4, "a b c", ""), (4, "a b c", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in op2.near_components(df).collect())
    assert got == [(0, 2, None, True), (0, 2, None, True), (4, 2, 4, True), (4, 2, 4, True)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 200) for i in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 130), 200]}
