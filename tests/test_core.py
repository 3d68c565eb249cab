from __future__ import annotations

import io
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessarine.functions import text as T
from tessarine.operators import context as C
from tessarine.operators import graph as G
from tessarine.operators import rank as R
from tessarine.operators import resolve, sinks
from tessarine.operators.slicing import interprocedural, python_slice, slice_lines, tokens
from tessarine.plans import catalog
from tessarine.plans.memory import CodeMemory
from tessarine.plans.tools import SCHEMAS, Tools, main, serve
from tessarine.sources import route, scan
from tessarine.streaming import incremental

SF = "/root/testdata/sf0.001"
FILES = {
    "shop/pay.py": '''"""Payments."""
from shop.net.web import get_json
import shop.net.web


class PayError(Exception):
    """Payment went wrong."""


def valid_number(number):
    """Check the digits of a card number."""
    total = 0
    note = "unused"
    for d in number:
        total += int(d)
    return total % 10 == 0


class Till:
    """Takes money."""

    def charge(self, number, amount):
        """Charge a card."""
        if not self.known(number):
            raise PayError("no")
        web.get_json("/charge")
        return get_json(f"/pay/{amount}")

    def known(self, number):
        return valid_number(number)
''',
    "shop/net/web.py": '''import time


def get_json(path, tries=3):
    """Fetch a path as JSON with retries."""
    for _ in range(tries):
        time.sleep(0)
    return {}
''',
    "shop/__init__.py": "",
    "web/app.ts": "export async function load(id: string) {\n  const r = await fetch(`/api/items/${id}`);\n  return r.json();\n}\nclass Cart {\n  // adds\n  add(x) { this.total(x); }\n  total(y) { return y; }\n}\n",
    "api/items.py": "@app.route('/api/items/<id>')\ndef one_item(id):\n    return {}\n",
    "native/fast.cpp": 'extern "C" int fast_sum(int a, int b) {\n  return a + b;\n}\n',
    "native/use.py": "def add(a, b):\n    return ctypes.CDLL(\"x\").fast_sum(a, b)\n",
    "notes.md": "# Title\nx\n## Part\ny\n## Part\nz\n",
    ".hidden.py": "def no(): pass\n",
    "skip/me.py": "def no(): pass\n",
    "big.min.js": "var a;",
    ".gitignore": "skip/\n*.log\n!keep.log\n",
    "a.log": "x",
    "keep.log": "y",
    "yarn.lock": "z",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, body in FILES.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_text(body)
    return str(root)


@pytest.fixture(scope="module")
def memory(spark, repo):
    m = CodeMemory(spark, trace_api_calls=True)
    m.index_repo(repo)
    return m


def test_scan_and_report(spark, repo):
    report: dict = {}
    names = [r for r, _ in scan.list_files(repo, report=report)]
    assert names == sorted(names, key=lambda n: [0]) and "skip/me.py" not in names and "a.log" not in names and "keep.log" in names and "shop/__init__.py" in names
    assert report == {"dotfiles": 2, "gitignored_dirs": 1, "gitignored_files": 1, "generated_files": 1}
    assert scan.pattern_regex("a/**/b*.[ch]/") == (r"^a/(?:.*/)?b[^/]*\.[ch](?:/.*)?$", True)


def test_graph_edges(memory):
    got = {(r.src, r.kind, r.dst) for r in memory.edges.collect()}
    p, w = "shop/pay.py::", "shop/net/web.py::"
    assert {(p + "Till.charge", "calls", p + "Till.known"), (p + "Till.charge", "calls", p + "PayError"), (p + "Till.known", "calls", p + "valid_number"), (p + "Till.charge", "calls", w + "get_json")} <= got
    assert (p + "Till", "contains", p + "Till.charge") in got and ("file:shop/pay.py", "contains", p + "valid_number") in got
    assert ("web/app.ts::load", "api_calls", "api/items.py::one_item") in got
    assert ("native/use.py::add", "ffi_calls", "native/fast.cpp::fast_sum") in got
    assert ("web/app.ts::Cart.add", "calls", "web/app.ts::Cart.total") in got


def test_retrieval_and_context(memory, tmp_path):
    cards = memory.search_code("check the digits of a card number", 3)
    assert cards[0]["chunk_id"] == "shop/pay.py::valid_number"
    found = memory.find_existing("fetch JSON with retries", 2)
    assert found[0]["chunk_id"] == "shop/net/web.py::get_json" and found[0]["strong_match"]
    got = memory.build_context("charge a card", 600)
    assert got["tokens"] <= 700 and "Till.charge" in got["text"] and got["text"].endswith(C.INSTRUCTION)
    memory.save(str(tmp_path / "index"))
    again = CodeMemory.load(memory.spark, str(tmp_path / "index"))
    assert sorted(r.chunk_id for r in again.chunks.collect()) == sorted(r.chunk_id for r in memory.chunks.collect())
    with pytest.raises(ValueError):
        memory.chunk("none")


def test_tools_and_loop(memory, capsys):
    t = Tools(memory)
    assert set(t.table) == {s["name"] for s in SCHEMAS}
    assert t.dispatch("get_callers", {"chunk_id": "shop/pay.py::valid_number"}) == ["shop/pay.py::Till.known"]
    assert "shop/pay.py::Till.charge" in t.dispatch("predict_impact", {"chunk_id": "shop/pay.py::valid_number"})["transitive_callers"]
    lines = ['{"id": 1, "method": "initialize"}', "no json", '{"method": "notifications/x"}', '{"id": 2, "method": "tools/list"}', '{"id": 3, "method": "tools/call", "params": {"name": "find_chunks_by_name", "arguments": {"name": "TILL"}}}', '{"id": 4, "method": "tools/call", "params": {"name": "nope"}}', '{"id": 5, "method": "what"}']
    out = io.StringIO()
    serve(t, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601
    assert len(json.loads(got[2]["result"]["content"][0]["text"])) == 3
    assert main(["schemas"]) == 0 and "search_code" in capsys.readouterr().out


def test_slices():
    src = FILES["shop/pay.py"].split("def valid_number", 1)[1].split("\n\n\nclass")[0]
    keep = python_slice("def valid_number" + src, {"total"})
    lines = ("def valid_number" + src).splitlines()
    text = "\n".join(lines[i] for i in keep)
    assert "unused" not in text and "total += int(d)" in text and "for d in number" in text and "return" in text
    assert python_slice("def (", set()) is None and slice_lines("<p>", "html", set()) is None
    js = "function f(a) {\n  let x = a + 1;\n  let y = 2;\n  if (x > 1) {\n    return x;\n  }\n}"
    kept = slice_lines(js, "javascript", set())
    assert 1 in kept and 2 not in kept and {0, 3, 4, 6} <= set(kept)
    chunks = {"a": {"source": "def a():\n    b()\n    return total", "language": "python", "kind": "function", "calls": ["b"]}, "b": {"source": "def b():\n    total = 1\n    return total", "language": "python", "kind": "function", "calls": []}}
    assert [i for i, _ in interprocedural(chunks, {"a": ["b"]}, "a", {"total"})] == ["a", "b"]
    assert [i for i, _ in interprocedural(chunks, {"a": ["b"]}, "a", {"total"}, max_depth=0)] == ["a"]


def test_compress_and_knapsack():
    code = "def f(a):\n" + "".join(f"    # note {i}\n    x{i} = a + {i}\n" for i in range(60)) + "    return x3\n"
    got = C.compress(code, "x3", 120)
    assert got["compressed_tokens"] < got["original_tokens"] and "def f(a):" in got["text"] and "return x3" in got["text"] and "elided" in got["text"]
    assert C.compress("a\nb", "q", 1)["text"] == "a\nb"
    r = random.Random(1)
    for _ in range(40):
        items = [[(str(v), r.randint(1, 40), r.randint(0, 9) / 2, "") for v in range(r.randint(1, 3))] for _ in range(r.randint(1, 5))]
        budget = r.randint(4, 80)
        cells = max(1, budget // 4)

        def worth(pick):
            used = sum(max(1, -(-items[i][v][1] // 4)) for i, v in enumerate(pick) if v is not None)
            return sum(items[i][v][2] for i, v in enumerate(pick) if v is not None) if used <= cells else -1

        best = max(worth(p) for p in itertools.product(*[[None, *range(len(x))] for x in items]))
        assert abs(sum(v[2] for _, v in C.knapsack(items, budget)) - best) < 1e-9
    assert C.shares([100, 300], 200) == [80, 150] or sum(C.shares([100, 300], 200)) <= 230


def test_parsers():
    def parsed(path, text):
        return [(c["kind"], c["qualname"]) for c in route.parse_file(path, text)[1]]

    assert parsed("a.go", "func (s *Store) Get(k string) int {\n\treturn 1\n}\nfunc main() {}\n") == [("method", "Store.Get"), ("function", "main")]
    assert parsed("a.java", "class A {\n  // }\n  int f(int x) { return x; }\n  String s = \"}\";\n  void g() {}\n}\n") == [("class", "A"), ("method", "A.f"), ("method", "A.g")]
    assert parsed("a.rs", "impl Foo for Bar {\n  fn x(&self) -> i32 { 1 }\n}\nfn main() {}\n") == [("impl", "Bar"), ("method", "Bar.x"), ("function", "main")]
    assert parsed("a.rb", "module M\n  class A\n    def x\n      if y\n        1\n      end\n    end\n  end\nend\n") == [("module", "M"), ("class", "M.A"), ("method", "M.A.x")]
    assert parsed("q.sql", "CREATE TABLE t (a int);\nCREATE OR REPLACE VIEW v AS SELECT ';' FROM t;\nCREATE TABLE t (b int);") == [("table", "t"), ("view", "v"), ("table", "t#2")]
    assert parsed("Makefile", ".PHONY: a\na: b\n\techo\n\nb:\n\ttrue\n") == [("target", "a"), ("target", "b")]
    assert parsed("x.md", FILES["notes.md"]) == [("section", "Title"), ("section", "Title > Part"), ("section", "Title > Part#2")]
    assert parsed("x.yml", "a: 1\nb:\n  c: 2\n") == [("key", "a"), ("key", "b")] and parsed("x.yml", "- 1\n") == []
    assert parsed("x.css", "a { b: c }\n@media x { d { e: f } }") == [("rule", "a"), ("at_rule", "@media x"), ("rule", "@media x.d")]
    assert parsed("x.html", "<nav><p>a</nav><div id=q></div><script>f(1)</script>") == [("element", "nav@L1"), ("element", "div#q"), ("script", "script@L1")]
    assert parsed("x.unknown", "\n".join("text" for _ in range(85))) == [("segment", "L1-40"), ("segment", "L41-80"), ("segment", "L81-85")]
    assert route.parse_file("x.bin", "\0") == ("skipped_binary", []) and route.parse_file("x.py", "def (") == ("indexed", [])
    for ext in (*route.brace.GRAMMARS, *route.endblock.SPECS, *route._FORMATS, ".html", ".zzz"):
        assert route.parse_file("f" + ext, "") [0] == "indexed"
        assert route.parse_file("f" + ext, "}}{ ((\nend\nclass A {\n'\"")[0] == "indexed"


def test_table_texts_with_long_lines_are_chunked(spark, monkeypatch):
    long = "x" * 5000
    df = spark.createDataFrame([(1, f"<nav>{long}</nav><script>f()</script>"), (2, f"# A\n{long}\n# B\n"), (3, "a\0b"), (4, None)], "id long, text string")

    def got(suffix):
        return sorted((r.file, r.kind, r.name) for r in scan.chunk_texts(df, "id", "text", suffix).collect())

    assert [x for x in got(".html") if x[0] == "1.html"] == [("1.html", "element", "nav@L1"), ("1.html", "script", "script@L1")]
    assert [x[0] for x in got(".md")] == ["1.md", "2.md", "2.md", "3.md"] and [x[0] for x in got(".txt")] == ["1.txt", "2.txt", "3.txt"]
    assert route.parse_file("a.html", f"<nav>{long}</nav>") == ("skipped_binary", [])  # a source tree keeps its guard

    def broken(path, source):
        raise ValueError("odd syntax")

    monkeypatch.setattr(route, "parser_for", lambda path, source: broken)
    with pytest.raises(ValueError, match="odd syntax"):
        route.parse_text("a.md", "x")
    assert route.parse_file("a.md", "x") == ("skipped_parse_error", [])


def test_tokens_are_the_native_expression(spark):
    texts = ["getHTTPResponse_code x2y _users 2fa", "", "É camelCase __init__ ABCDef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.code_tokens(F.col("t"))).collect()] == [tokens(t) for t in texts]


def test_pagerank_and_closure_with_lost_rank(spark):
    e = spark.createDataFrame([("a", "calls", "b"), ("b", "calls", "c"), ("c", "calls", "a"), ("a", "calls", "d")], "src string, kind string, dst string")
    pr = {r.id: r.ppr for r in G.personalized_pagerank(e, spark.createDataFrame([("a", 1.0), ("x", -1.0)], "id string, weight double")).collect()}
    assert set(pr) == {"a", "b", "c", "d"} and abs(sum(pr.values()) - 1) < 1e-6
    assert sorted(r.id for r in G.transitive_closure(e, spark.createDataFrame([("b",)], "id string")).collect()) == ["a", "b", "c", "d"]
    assert resolve.BUILTINS


def test_converged_pagerank_by_brute_force(spark):
    edges = {(r.src, r.dst) for r in catalog._edges(spark, SF).collect()}
    nodes = sorted({x for e in edges for x in e})
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    pr = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(50):
        lost = sum(pr[x] for x in nodes if x not in out)
        nxt = dict.fromkeys(nodes, (0.15 + 0.85 * lost) / len(nodes))
        for a, to in out.items():
            for b in to:
                nxt[b] += 0.85 * pr[a] / len(to)
        gap, pr = sum(abs(nxt[x] - pr[x]) for x in nodes), nxt
        if gap < 1e-9:
            break
    got = {r.id: r.ppr for r in catalog.QUERIES["pagerank_converged"](spark, SF).collect()}
    assert set(got) == set(nodes) and max(abs(got[x] - pr[x]) for x in nodes) < 2e-9
    want = sorted(((-round(pr[x], 6), x) for x in nodes))[:10]
    top = [(-r.ppr, r.id) for r in catalog.QUERIES["central_nodes_converged"](spark, SF).collect()]
    assert [x for _, x in top] == [x for _, x in want] and max(abs(a - b) for (a, _), (b, _) in zip(top, want)) < 2e-6


def test_boost_of_every_node_and_of_missing_ones(spark):
    scores = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 2.0), ("q", "c", 1.0)], "query_id string, doc_id string, score double")
    central = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "doc_id string, ppr double")
    got = {r.doc_id: r.score for r in R.boost(scores, central, 0.1).collect()}
    assert got == pytest.approx({"a": 3.8, "b": 2.2, "c": 0.9})
    every = {(r.query_id, r.doc_id): r.score for r in catalog.QUERIES["boost_scores_all"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey").collect()
    top = max(r.c_nationkey for r in rows)
    most = {s: float(max(r.c_acctbal for r in rows if r.c_mktsegment == s)) for s in {r.c_mktsegment for r in rows}}
    for r in rows:
        want = 0.9 * float(r.c_acctbal) + 0.1 * r.c_nationkey / top * most[r.c_mktsegment] if most[r.c_mktsegment] > 0 else float(r.c_acctbal)
        assert every[r.c_mktsegment, f"c{r.c_custkey}"] == pytest.approx(want, abs=2e-6)


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([('a"<', "calls", "b\\"), ("file:x", "contains", 'a"<')], "src string, kind string, dst string")
    for name, fn in (("cypher", sinks.cypher), ("graphml", sinks.graphml), ("dot", sinks.dot)):
        sinks.write_text(fn(e), str(tmp_path / name))
        text = "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert "calls" in text.lower()
    import xml.dom.minidom

    assert xml.dom.minidom.parseString("\n".join(r.line for r in sinks.graphml(e).orderBy("part", "ord").collect()))


def test_streaming_snapshots(spark, tmp_path):
    schema = "path string, mtime double, size long, hash string"
    src = tmp_path / "in"
    for n, rows in enumerate(([("a", 1.0, 1, "x"), ("b", 1.0, 1, "y")], [("a", 2.0, 2, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.mtime) for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()) == [("a", 2.0), ("b", 1.0)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalog(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        return
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = c.sql(catalog.ORACLE_SQL[name])
    at = [list(got.columns).index(x) for x in cols]
    want = [tuple(r[i] for i in at) for r in got.fetchall()]
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=str), sorted(want, key=str)):
        assert all(x == y or abs(x - y) < 1e-8 for x, y in zip(a, b)), (a, b)
