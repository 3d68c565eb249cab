"""Retrieval: BM25, dense cosine, rank fusion, expansion, weights, metrics.

Everything is keyed by query_id, so a batch of queries is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, dot, idf, unit
from ..runtime import broadcast_if_small, materialize
from .blocks import K1, RRF, B, Bm25, dense_best


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf): repeated tokens count repeatedly."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(code_tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf) of all documents."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(code_tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with the query.

    Only tokens that some query asks for are counted and shuffled; lengths are
    array sizes in the scan, so the whole index is never built for a query.
    """
    asked = query_terms(queries)
    terms = broadcast_if_small(asked.select("term").distinct())
    toks = docs.select(F.col(id_col).alias("doc_id"), code_tokens(F.col(text_col)).alias("t"))
    sized = toks.select("doc_id", F.greatest(F.lit(1), F.size("t")).alias("dl"), "t")
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select("doc_id", "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(broadcast_if_small(df.join(F.broadcast(stats))), "term").select("doc_id", "term", weight.alias("w"))
    return hits.join(broadcast_if_small(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def ranked(scores: DataFrame, by: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds ``rank``: score descending, then id."""
    w = Window.partitionBy("query_id").orderBy((F.col("score") if by is None else by).desc(), id_col)
    return scores.withColumn("rank", F.row_number().over(w))


def top(scores: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best of each query; limited per partition before the shuffle."""
    return ranked(scores, id_col=id_col).where(F.col("rank") <= k)


def bm25_pooled(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) where all texts of one id are one document."""
    tf = materialize(postings(docs, id_col, text_col), "postings")
    dl = docs.select(F.col(id_col).alias("doc_id")).distinct().join(tf.groupBy("doc_id").agg(F.sum("tf").alias("s")), "doc_id", "left").select("doc_id", F.greatest(F.lit(1), F.coalesce("s", F.lit(0))).alias("dl"))
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(query_terms(queries), "term").join(df, "term").join(dl, "doc_id").join(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * w).alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6, id_col: str = "doc_id", pooled: bool = False, batch: Bm25 | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best by rounded score, without a row for every pair of query and document."""
    batch = batch or Bm25(docs, query_terms(queries), id_col, pooled=pooled)
    if batch.held:
        return top(batch.top(k, digits), k)
    every = bm25_pooled(docs, queries, id_col) if pooled else bm25(docs, queries, id_col)
    return top(every.withColumn("score", F.round("score", digits)), k)


def dense(docs: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score): cosine of every pair of query and document.

    The stated queries meet all rows in blocks: each block of queries is one
    row, joined by its number, so neither side has to fit in memory.
    """
    n_blocks = max(1, -(-queries.count() // 256))
    q = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), F.struct("query_id", unit(F.col("vector")).alias("v")).alias("q")).groupBy("block").agg(F.collect_list("q").alias("qs"))
    d = docs.select(F.col(id_col).alias("doc_id"), unit(F.col(vec_col)).alias("u")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = d.join(broadcast_if_small(q, 64), "block").select("doc_id", "u", F.explode("qs").alias("q"))
    return pairs.select("q.query_id", "doc_id", dot(F.col("u"), F.col("q.v")).alias("score"))


def dense_top(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best by rounded cosine, as of every pair, which none keeps.

    Work grows with queries times documents.  Vectors that have gaps, odd
    numbers or another length than most queries meet the rest as joined tables.
    """
    q = materialize(queries.select("query_id", unit(F.col("vector")).alias("v")), "queries")
    usual = q.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    big = F.lit(float("inf"))

    def marked(rows: DataFrame, v: str) -> DataFrame:
        whole = F.forall(v, lambda x: F.coalesce((x < big) & (x > -big), F.lit(False)))
        return rows.withColumn("plain", F.coalesce((F.size(v) == (usual.w if usual else 0)) & (F.size(v) > 0) & whole, F.lit(False)))

    shares = 4 * docs.sparkSession.sparkContext.defaultParallelism  # of the work, which doesn't follow the size of the table
    d = docs.repartition(shares).select(F.col(id_col).alias("doc_id"), unit(F.col(vec_col)).alias("u"))
    d, q = materialize(marked(d, "u"), "vectors"), marked(q, "v")
    best = dense_best(d.where("plain"), q.where("plain"), k, digits)
    for some_d, some_q in ((d.where("not plain"), q), (d.where("plain"), q.where("not plain"))):
        if not some_d.isEmpty() and not some_q.isEmpty():
            best = best.unionByName(some_d.crossJoin(some_q).select("query_id", "doc_id", dot(F.col("u"), F.col("v")).alias("score")))
    return top(best.withColumn("score", F.round("score", digits)), k)


def rrf_fuse(rankings: Sequence[DataFrame]) -> DataFrame:
    """Reciprocal ranks of (query_id, doc_id, rank) tables, summed."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))


#: queries whose marked rows the driver holds
FUSED_QUERIES = 4096


def rrf_by_age(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): the k best of two fused rankings of a query's hits, by rounded score, and by a numeric id, the smallest first.

    Scores are unrounded and rows more than k; ``top`` ends it.
    """
    batch = Bm25(docs, query_terms(queries))
    if batch.held and len(batch.asked.ids) <= FUSED_QUERIES:
        return batch.fused(k, digits)
    s = materialize(bm25(docs, queries).withColumn("score", F.round("score", digits)), "scores")
    return rrf_fuse([ranked(s), ranked(s, -F.col("doc_id"))])


def expand(scores: DataFrame, edges: DataFrame, decay: float = 0.35, hops: int = 1) -> DataFrame:
    """Neighbours over undirected ``calls`` gain decay * the best positive neighbour's score."""
    calls = edges.where("kind = 'calls'").select("src", "dst")
    both = calls.unionByName(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = scores
    for _ in range(hops):
        bonus = front.where("score > 0").join(both, F.col("doc_id") == F.col("src")).groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.max(F.col("score") * decay).alias("bonus"))
        scores = scores.join(bonus, ["query_id", "doc_id"], "full").select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
        front = bonus.withColumnRenamed("bonus", "score")
    return scores


def rerank(scores: DataFrame, judged: DataFrame, n: int = 20) -> DataFrame:
    """The n best rows rescaled by a judge's (query_id, doc_id, judge_score)."""
    w = Window.partitionBy("query_id")
    r = ranked(scores).withColumn("base", F.max("score").over(w))
    head = r.where(F.col("rank") <= n).join(judged, ["query_id", "doc_id"], "left")
    lo, hi = F.min("judge_score").over(w), F.max("judge_score").over(w)
    head = head.withColumn("lo", lo).withColumn("span", F.when(hi > lo, hi - lo).otherwise(1.0))
    new = F.coalesce(F.col("base") * (1 + (F.col("judge_score") - F.col("lo")) / F.col("span")), F.col("score"))
    return head.select("query_id", "doc_id", new.alias("score")).unionByName(r.where(F.col("rank") > n).select("query_id", "doc_id", "score"))


def boost(scores: DataFrame, central: DataFrame, weight: float | Column) -> DataFrame:
    """Blend with a (doc_id, ppr) centrality table, both scaled by their maxima."""
    b = F.lit(weight) if isinstance(weight, float) else weight
    top_ppr = central.agg(F.max("ppr").alias("top_ppr"))
    w = Window.partitionBy("query_id")
    s = scores.join(central, "doc_id", "left").join(F.broadcast(top_ppr)).withColumn("m", F.max("score").over(w))
    mix = ((1 - b) * F.col("score") / F.col("m") + b * F.coalesce("ppr", F.lit(0.0)) / F.col("top_ppr")) * F.col("m")
    return s.select("query_id", "doc_id", F.when(F.col("m") > 0, mix).otherwise(F.col("score")).alias("score"))


def auto_weights(queries: DataFrame, names: DataFrame, fused: DataFrame) -> DataFrame:
    """(query_id, graph_boost, ppr_weight): less graph the more the query names code.

    ``names`` is (term): tokens of all names.  The spread of the ten best fused
    scores scales the weight; the result stays within 0.02 and 0.2.
    """
    vocab = names.select("term").distinct().withColumn("known", F.lit(1))
    q = query_terms(queries).join(vocab, "term", "left").groupBy("query_id").agg((F.sum(F.when(F.col("known") == 1, F.col("qtf")).otherwise(0)) / F.sum("qtf")).alias("ratio"))
    spread = top(fused, 10).groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    cv = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("sd") / F.col("mean")))
    factor = F.when((F.col("n") > 1) & (F.col("mean") > 0), 0.8 + 0.4 * (1 - cv)).otherwise(1.0)
    raw = (0.03 + 0.12 * (1 - F.coalesce("ratio", F.lit(0.0)))) * factor
    gb = F.least(F.lit(0.2), F.greatest(F.lit(0.02), raw))
    return queries.select("query_id").join(q, "query_id", "left").join(spread, "query_id", "left").select("query_id", gb.alias("graph_boost"), (gb * 0.8).alias("ppr_weight"))


def strong_match(scores: DataFrame) -> DataFrame:
    """Adds ``strong_match``: at least half of the query's best score."""
    return scores.withColumn("strong_match", F.col("score") >= 0.5 * F.max("score").over(Window.partitionBy("query_id")))


def ir_metrics_by_label(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """``ir_metrics`` where every other row of the query's label is relevant: (query_id, label) and (doc_id, label) tables.

    Only pairs among the hits are looked at; a query counts if its label has a row of another id.
    """
    q, d = queries.select("query_id", "label").distinct(), docs.select("doc_id", "label")
    near = hits.where(F.col("rank") <= k).join(d, "doc_id").join(q, ["query_id", "label"]).where(F.col("query_id") != F.col("doc_id"))
    ids = d.groupBy("label").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    asked = q.join(broadcast_if_small(ids), "label").where((F.col("a") != F.col("query_id")) | (F.col("z") != F.col("query_id"))).select("query_id").distinct()
    return _metrics(asked, near.groupBy("query_id").agg(F.min("rank").alias("r")))


def ir_metrics(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Hit rate, MRR and precision at 1 of ranked (query_id, doc_id, rank) tables."""
    first = hits.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return _metrics(relevant.select("query_id").distinct(), first)


def _metrics(asked: DataFrame, first: DataFrame) -> DataFrame:
    every = asked.join(first, "query_id", "left")
    return every.agg(F.count("*").alias("n_queries"), F.avg(F.col("r").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("r") == 1).cast("double"), F.lit(0.0))).alias("p_at_1"))


def two_stage(files: DataFrame, chunks: DataFrame, queries: DataFrame, k_files: int = 4, k_chunks: int = 10) -> DataFrame:
    """Best chunks (query_id, doc_id, score, rank) within each query's best files.

    ``files`` is (doc_id, text), ``chunks`` (doc_id, text, file).  Ranks are
    taken over all chunks before the semi join: fusion needs the full order.
    """
    coarse = top(bm25(files, queries), k_files).select("query_id", F.col("doc_id").alias("file"))
    fine = rrf_fuse([ranked(bm25(chunks, queries))]).join(chunks.select("doc_id", "file"), "doc_id")
    return top(fine.join(broadcast_if_small(coarse), ["query_id", "file"], "left_semi"), k_chunks)
