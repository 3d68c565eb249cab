"""A code base as tables: index, retrieve, explain, build contexts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import graph as G
from ..operators import rank as R
from ..operators import resolve, sinks
from ..operators.slicing import interprocedural, tokens
from ..runtime import materialize
from ..sources import scan


class CodeMemory:
    """Chunks, edges and centrality of one code base; each answer is a small job.

    ``encode_fn(texts) -> vectors`` adds a dense ranking, ``rerank_fn(query,
    texts) -> scores`` a judge (if it fails the order stays).
    """

    def __init__(self, spark: SparkSession, trace_api_calls: bool = False, encode_fn: Callable | None = None, rerank_fn: Callable | None = None):
        self.spark, self.trace, self.encode_fn, self.rerank_fn = spark, trace_api_calls, encode_fn, rerank_fn
        self.root, self.report = "", {}

    def index_repo(self, root: str) -> dict[str, int]:
        listed: dict[str, int] = {}
        files = scan.files_frame(self.spark, root, listed)
        parsed = materialize(scan.parse_files(files), "parsed")
        self.root, self.report = root, scan.index_report(parsed) | listed
        self._build(scan.chunks_of(parsed))
        return self.report

    def save(self, path: str) -> None:
        sinks.save_index(self.chunks, path, self.root, self.trace)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw) -> CodeMemory:
        head, chunks = sinks.load_index(spark, path)
        m = cls(spark, trace_api_calls=head["trace_api_calls"], **kw)
        m.root = head["root"]
        m._build(chunks)
        return m

    def _build(self, chunks: DataFrame) -> None:
        self.chunks = materialize(chunks, "chunks")
        edges = resolve.code_graph(self.chunks)
        self.edges = materialize(resolve.annotate(self.chunks, edges) if self.trace else edges, "edges")
        ids = self.chunks.select(F.col("chunk_id").alias("id")).distinct()
        ppr = G.personalized_pagerank(self.edges, ids.withColumn("weight", F.lit(1.0)))
        self.centrality = materialize(ppr.withColumnRenamed("id", "doc_id"), "centrality")
        c = self.chunks
        one = c.groupBy("chunk_id").agg(F.max("chunk_ord").alias("chunk_ord"))
        self.last = c.join(one, ["chunk_id", "chunk_ord"], "left_semi")  # of repeated ids the last
        self.docs = c.select("chunk_ord", F.col("chunk_id"), "file", T.search_text().alias("doc"), T.symbol_text().alias("sym"))

    def _queries(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, text string")

    def _fused(self, query: str, unit: str) -> DataFrame:
        q, d = self._queries(query), self.docs
        rankings = []
        for view in ("doc", "sym"):
            src = d.select(F.col(unit).alias("doc_id"), F.col(view).alias("text"))
            if unit == "file":
                src = src.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
            rankings.append(R.ranked(R.bm25(src, q)))
        if self.encode_fn is not None:
            fn = self.encode_fn

            @F.pandas_udf("array<double>")
            def encode(s: pd.Series) -> pd.Series:
                return pd.Series([list(map(float, v)) for v in fn(list(s))])

            src = d.select(F.col(unit).alias("doc_id"), F.col("doc").alias("text"))
            if unit == "file":
                src = src.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
            rankings.append(R.ranked(R.dense(src.withColumn("embedding", encode("text")), q.withColumn("vector", encode("text")), "doc_id")))
        return R.rrf_fuse(rankings)

    def files(self, query: str, k: int = 4) -> list[tuple[str, float]]:
        return [(r.doc_id, round(100 * r.score, 3)) for r in R.top(self._fused(query, "file"), k).orderBy("rank").collect()]

    def _scores(self, query: str) -> DataFrame:
        """All chunks' final scores: fused, expanded, reranked, boosted."""
        fused = materialize(self._fused(query, "chunk_id"), "fused")
        names = self.chunks.select(F.explode(T.code_tokens(F.concat_ws(" ", "name", "qualname"))).alias("term"))
        weights = R.auto_weights(self._queries(query), names, fused).first()
        self.weights = (weights.graph_boost, weights.ppr_weight)
        s = R.expand(fused, self.edges)
        known = self.chunks.select(F.col("chunk_id").alias("doc_id")).distinct()
        s = s.join(known, "doc_id", "left_semi").select("query_id", "doc_id", "score")
        if self.rerank_fn is not None:
            head = R.top(s, 20).join(self.last, F.col("doc_id") == F.col("chunk_id")).select("doc_id", F.concat_ws("\n", "signature", T.doc_summary(F.col("docstring"))).alias("t")).orderBy("doc_id").collect()
            try:
                judged = self.spark.createDataFrame([(0, r.doc_id, float(x)) for r, x in zip(head, self.rerank_fn(query, [r.t for r in head]))], "query_id long, doc_id string, judge_score double")
                s = R.rerank(s, judged)
            except Exception:  # a judge that fails leaves the order as it was
                pass
        return R.boost(s, self.centrality, float(weights.graph_boost))

    def cards(self, query: str, k: int = 10, files: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The k best chunks (after the filters) with their fields, score (x 100) and rank."""
        s = self._scores(query).join(self.last.withColumnRenamed("chunk_id", "doc_id"), "doc_id")
        if files is not None:
            s = s.where(F.col("file").isin(files))
        if kinds is not None:
            s = s.where(F.col("kind").isin(*kinds))
        top = R.top(s.withColumn("score", F.col("score") * 100), k).withColumnRenamed("doc_id", "chunk_id")
        return top.withColumn("card", T.card()).withColumn("query", F.lit(query))

    def search_code(self, query: str, k: int = 10) -> list[dict]:
        return [self._card(r) for r in self.cards(query, k).orderBy("rank").collect()]

    @staticmethod
    def _card(r) -> dict:
        d = (r.docstring or "").strip().splitlines()
        return {"chunk_id": r.chunk_id, "score": round(r.score, 3), "kind": r.kind, "file": r.file, "start_line": r.start_line, "end_line": r.end_line, "signature": r.signature, "doc_summary": d[0].strip() if d else ""}

    def retrieve(self, query: str, k_files: int = 4, k_chunks: int = 10) -> tuple[list[tuple[str, float]], DataFrame]:
        """Two stages, then a blend with PageRank from the cards themselves."""
        files = self.files(query, k_files)
        cards = materialize(self.cards(query, 2 * k_chunks, [f for f, _ in files]), "cards")
        pref = cards.select(F.col("chunk_id").alias("id"), F.col("score").alias("weight"))
        ppr = G.personalized_pagerank(self.edges, pref).select(F.col("id").alias("doc_id"), "ppr")
        blended = R.boost(cards.select("query_id", F.col("chunk_id").alias("doc_id"), "score"), ppr, float(self.weights[1]))
        top = R.top(blended, k_chunks).withColumnRenamed("doc_id", "chunk_id")
        return files, cards.drop("score", "rank", "query_id").join(top, "chunk_id")

    def find_existing(self, description: str, k: int = 5) -> list[dict]:
        got = self.cards(description, k, kinds=("function", "method")).orderBy("rank").collect()
        best = got[0].score if got else 0.0
        return [self._card(r) | {"strong_match": r.score >= 0.5 * best} for r in got]

    def build_context(self, query: str, token_budget: int = 1800, *, fetch_bodies: int = 2, k_chunks: int = 10, k_files: int = 4) -> dict:
        files, cards = self.retrieve(query, k_files, k_chunks)
        rows = [r.asDict() for r in cards.orderBy("rank").collect()]
        return C.build_context(query, files, rows, self.find_existing(query, 3), token_budget, fetch_bodies)

    def chunk(self, chunk_id: str) -> dict:
        r = self.last.where(F.col("chunk_id") == chunk_id).first()
        if r is None:
            raise ValueError(f"unknown chunk_id {chunk_id!r}")
        return r.asDict()

    def find_chunks_by_name(self, name: str) -> list[str]:
        x = name.lower()
        return [r.chunk_id for r in self.chunks.where(F.lower("name").contains(x) | F.lower("qualname").contains(x)).orderBy("chunk_ord").select("chunk_id").collect()]

    def slice(self, chunk_id: str, query: str, max_depth: int | None = None) -> list[dict]:
        """The chunk's backward slice and those of callees that write what is asked for."""
        self.chunk(chunk_id)
        near = G.transitive_closure(self.edges, self.spark.createDataFrame([(chunk_id,)], "id string")).select("id")
        chunks = {r.chunk_id: r.asDict() for r in self.last.join(near, F.col("chunk_id") == F.col("id"), "left_semi").collect()}
        callees: dict[str, list[str]] = {}
        for r in self.edges.where("kind = 'calls'").join(near, F.col("src") == F.col("id"), "left_semi").select("src", "dst").distinct().orderBy("src", "dst").collect():
            callees.setdefault(r.src, []).append(r.dst)
        out = []
        for i, keep in interprocedural(chunks, callees, chunk_id, set(tokens(query)), max_depth):
            lines = chunks[i]["source"].splitlines()
            keep = keep if keep is not None else list(range(len(lines)))
            out.append({"chunk_id": i, "file": chunks[i]["file"], "lines": [chunks[i]["start_line"] + k for k in keep], "source": "\n".join(lines[k] for k in keep if k < len(lines))})
        return out

    def stats(self) -> dict:
        kinds = {r.kind: r["count"] for r in self.chunks.groupBy("kind").count().collect()}
        return G.graph_stats(self.chunks, self.edges).first().asDict() | {"kinds": kinds} | self.report
