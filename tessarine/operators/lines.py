"""Line-structured chunkers and budgets as native expressions, and surprisal."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, surprisal
from ..runtime import BROADCAST_ROWS, materialize, ship
from .slicing import tokens

SEGMENT = 40


def _lines(text):
    """Lines without the empty one after a final newline."""
    t = F.coalesce(text, F.lit(""))
    return F.split(F.regexp_replace(t, r"\n\z", ""), "\n")


def segments(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Fixed runs of lines: (doc_id, name, start_line, end_line, source); none for empty texts."""
    d = docs.where(F.length("text") > 0).select("doc_id", _lines(F.col("text")).alias("l"))
    d = d.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(size))).alias("s"))
    end = F.least(F.col("s") + size, F.size("l"))
    return d.select("doc_id", F.concat(F.lit("L"), F.col("s") + 1, F.lit("-"), end).alias("name"), (F.col("s") + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, F.lit(size)), "\n").alias("source"))


def sections(docs: DataFrame, heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """Runs from one heading line to the next: (doc_id, title, start_line, end_line)."""
    d = docs.where(F.length("text") > 0).select("doc_id", _lines(F.col("text")).alias("l"))
    n = d.select("doc_id", F.size("l").alias("n"), F.filter(F.transform("l", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: x["text"].rlike(heading)).alias("h"))
    h = n.select("doc_id", "n", F.posexplode("h").alias("i", "x"), F.col("h"))
    after = F.try_element_at("h", F.col("i") + 2)["line"]
    return h.select("doc_id", F.trim(F.regexp_extract("x.text", heading, 2)).alias("title"), F.col("x.line").cast("long").alias("start_line"), F.coalesce(after - 1, F.col("n")).cast("long").alias("end_line"))


#: different tokens that a worker counts before it hands them on
HELD_TERMS = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (term, count), combined as far as a worker holds them."""
    count: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "count"])

    for b in batches:
        for text in b.column(0):
            count.update(tokens(text.as_py()))
            if len(count) > HELD_TERMS:
                yield made()
                count.clear()
    if count:
        yield made()


def unigrams(docs: DataFrame) -> DataFrame:
    """(term, count) of all tokens."""
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(_counted, "term string, count long").groupBy("term").agg(F.sum("count").alias("count"))


def _weighed(known: dict[str, float]):
    """(id, text) -> a row (id, null, tokens, sum of what is known of them), and one (id, term, count, 0) for every other token of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.get
        for b in batches:
            at, terms, n, x = [], [], [], []
            for i, text in enumerate(b.column(1)):
                found = tokens(text.as_py())
                said = list(map(get, found))
                at.append(i)
                terms.append(None)
                n.append(len(found))
                x.append(float(sum(filter(None, said))))
                if None in said:
                    rest = Counter(w for w, s in zip(found, said) if s is None)
                    at += repeat(i, len(rest))
                    terms += rest.keys()
                    n += rest.values()
                    x += repeat(0.0, len(rest))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(x, pa.float64())], names=["doc_id", "term", "n", "x"])

    return run


def doc_surprisal(docs: DataFrame, weight: float = 0.6, held: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, score): weight * (mean surprisal of the text's tokens - the corpus mean); 0 without tokens.

    The most frequent tokens, ``held`` at most, are summed up where the text
    is; the others' counts meet them in a join.
    """
    counts = materialize(unigrams(docs), "unigrams")
    size = counts.agg(F.sum("count").alias("total"), F.count("*").alias("vocab")).first()
    s = counts.select("term", "count", surprisal(F.col("count"), F.lit(size.total or 0), F.lit(size.vocab)).alias("s"))
    mean = s.agg(F.sum(F.col("count") * F.col("s")) / F.sum("count")).first()[0] or 0.0
    room, least = held, 1
    for k, n in sorted(((r.k, r.n) for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True):
        room -= n
        if room < 0:
            least = 2 << k
            break
    known = {r.term: r.s for r in s.where(F.col("count") >= least).select("term", "s").collect()}
    parts = docs.select("doc_id", "text").mapInArrow(_weighed(known), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, n long, x double")
    if room < 0:
        parts = materialize(parts, "surprisal")
        rest = parts.where("term is not null").join(s.where(F.col("count") < least), "term").select("doc_id", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("s")).alias("x"))
        parts = parts.where("term is null").select("doc_id", "n", "x").unionByName(rest)
    per = parts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > 0")
    scored = per.select("doc_id", (weight * (F.col("x") / F.col("n") - mean)).alias("score"))
    return docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def budget_prefix(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows while their running token cost is within the budget; the first always stays."""
    w = Window.partitionBy(group).orderBy(order)
    cost = rows.withColumn("cost", approx_tokens(F.col(text)))
    cum = cost.withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w))
    return cum.where((F.col("nth") == 1) | (F.col("used") <= budget)).drop("nth")
