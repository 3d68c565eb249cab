"""Tools over a code memory: a dispatch table, a JSON-RPC loop, a command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import sinks
from .memory import CodeMemory


def _schema(name: str, text: str, /, **props: str) -> dict:
    kinds = {"k": "integer", "depth": "integer", "token_budget": "integer"}
    return {"name": name, "description": text, "input_schema": {"type": "object", "properties": {p: {"type": kinds.get(p, "string"), "description": d} for p, d in props.items()}, "required": [p for p in props if p not in kinds]}}


SCHEMAS = [
    _schema("search_code", "Rank chunks for a query.", query="what to look for", k="how many"),
    _schema("find_existing_implementations", "Functions that may already do it.", description="what it should do", k="how many"),
    _schema("get_function_body", "Source of a chunk.", chunk_id="chunk"),
    _schema("get_callees", "What a chunk calls.", chunk_id="chunk"),
    _schema("get_callers", "What calls a chunk.", chunk_id="chunk"),
    _schema("get_graph_stats", "Counts of the graph."),
    _schema("get_index_report", "What the scan took and left."),
    _schema("get_central_functions", "Chunks of the highest PageRank.", k="how many"),
    _schema("get_dependency_graph", "Neighbourhood of a chunk.", chunk_id="chunk", depth="steps"),
    _schema("get_api_trace", "Calls across languages.", chunk_id="chunk"),
    _schema("build_context", "A context within a token budget.", query="question", token_budget="tokens"),
    _schema("find_chunks_by_name", "Chunks whose name holds a string.", name="part of a name"),
    _schema("get_slice", "Backward slice for a query.", chunk_id="chunk", query="what matters"),
    _schema("predict_impact", "What a change may touch.", chunk_id="chunk"),
]


class Tools:
    def __init__(self, memory: CodeMemory):
        self.m = memory
        e = memory
        self.table = {
            "search_code": lambda query, k=10: e.search_code(query, k),
            "find_existing_implementations": lambda description, k=5: e.find_existing(description, k),
            "get_function_body": lambda chunk_id: {f: e.chunk(chunk_id)[f] for f in ("chunk_id", "file", "start_line", "end_line", "source")},
            "get_callees": lambda chunk_id: self._ids(G.callees_of(e.edges, chunk_id)),
            "get_callers": lambda chunk_id: self._ids(G.callers_of(e.edges, chunk_id)),
            "get_graph_stats": e.stats,
            "get_index_report": lambda: e.report,
            "get_central_functions": lambda k=10: [{"chunk_id": r.doc_id, "score": round(r.ppr, 6)} for r in e.centrality.orderBy(F.desc(F.round("ppr", 6)), "doc_id").limit(k).collect()],
            "get_dependency_graph": self._neighbourhood,
            "get_api_trace": lambda chunk_id: self._ids(G.cross_service_neighbors(e.edges, chunk_id)),
            "build_context": lambda query, token_budget=1800: e.build_context(query, token_budget),
            "find_chunks_by_name": lambda name: e.find_chunks_by_name(name),
            "get_slice": lambda chunk_id, query: e.slice(chunk_id, query),
            "predict_impact": lambda chunk_id, new_code=None: G.impact(e.edges, chunk_id),
        }

    @staticmethod
    def _ids(df) -> list[str]:
        return [r.id for r in df.collect()]

    def _neighbourhood(self, chunk_id: str, depth: int = 2) -> dict:
        spark = self.m.spark
        near = G.bfs(self.m.edges, spark.createDataFrame([(chunk_id,)], "id string"), depth).select("id").distinct()
        e = self.m.edges.where("kind <> 'contains'").join(near, F.col("src") == F.col("id"), "left_semi").join(near, F.col("dst") == F.col("id"), "left_semi").distinct()
        return {"nodes": self._ids(near.orderBy("id")), "edges": [list(r) for r in e.select("src", "kind", "dst").orderBy("src", "kind", "dst").collect()]}

    def dispatch(self, name: str, args: dict):
        if name not in self.table:
            raise ValueError(f"unknown tool {name!r}")
        return self.table[name](**args)


def serve(tools: Tools, stdin=None, stdout=None) -> None:
    """JSON-RPC, one message a line; lines that aren't JSON are skipped."""
    stdin, stdout = stdin or sys.stdin, stdout or sys.stdout
    for line in stdin:
        try:
            msg = json.loads(line)
        except ValueError:
            continue
        method, ident = msg.get("method", ""), msg.get("id")
        if method.startswith("notifications/"):
            continue
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessarine", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": s["name"], "description": s["description"], "inputSchema": s["input_schema"]} for s in SCHEMAS]}
        elif method == "tools/call":
            p = msg.get("params", {})
            try:
                result = {"content": [{"type": "text", "text": json.dumps(tools.dispatch(p.get("name", ""), p.get("arguments", {})))}]}
            except Exception as e:  # the caller gets the error, the loop goes on
                result = {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
        else:
            stdout.write(json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no method {method}"}}) + "\n")
            stdout.flush()
            continue
        stdout.write(json.dumps({"jsonrpc": "2.0", "id": ident, "result": result}) + "\n")
        stdout.flush()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessarine")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("index", ("root",)), ("query", ("index", "text")), ("body", ("index", "chunk_id")), ("find-chunks", ("index", "name")), ("mcp", ("index",)), ("graph-export", ("index",)), ("schemas", ())):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name in ("index", "graph-export"):
            s.add_argument("-o", "--output", required=True)
        if name == "index":
            s.add_argument("--trace-api-calls", action="store_true")
        if name == "query":
            s.add_argument("--budget", type=int, default=1800)
        if name == "graph-export":
            s.add_argument("--format", choices=("cypher", "graphml", "dot"), default="cypher")
    a = p.parse_args(argv)
    if a.command == "schemas":
        print(json.dumps(SCHEMAS, indent=2))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        m = CodeMemory(spark, trace_api_calls=a.trace_api_calls)
        print(json.dumps(m.index_repo(a.root)))
        m.save(a.output)
        return 0
    m = CodeMemory.load(spark, a.index)
    if a.command == "query":
        got = m.build_context(a.text, a.budget)
        print(got.pop("text"))
        print(json.dumps(got), file=sys.stderr)
    elif a.command == "body":
        print(m.chunk(a.chunk_id)["source"])
    elif a.command == "find-chunks":
        print("\n".join(m.find_chunks_by_name(a.name)))
    elif a.command == "graph-export":
        sinks.write_text({"cypher": sinks.cypher, "graphml": sinks.graphml, "dot": sinks.dot}[a.format](m.edges), a.output)
    else:
        serve(Tools(m))
    return 0


if __name__ == "__main__":
    sys.exit(main())
