"""Graph and index writers; texts are ordered rows, one per line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cypher_escape, xml_escape
from ..sources.chunk import FIELDS, SCHEMA
from .graph import nodes_of


def cypher(edges: DataFrame) -> DataFrame:
    """(part, ord, line): nodes sorted, a blank line, an edge per row."""
    n = nodes_of(edges).select(F.lit(0).alias("part"), F.col("id").alias("ord"), F.concat(F.lit("CREATE (:"), "label", F.lit(' {id: "'), cypher_escape(F.col("id")), F.lit('"});')).alias("line"))
    gap = edges.sparkSession.range(1).select(F.lit(1).alias("part"), F.lit("").alias("ord"), F.lit("").alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\x01", "src", "kind", "dst").alias("ord"), F.concat(F.lit('MATCH (a {id: "'), cypher_escape(F.col("src")), F.lit('"}), (b {id: "'), cypher_escape(F.col("dst")), F.lit('"}) CREATE (a)-[:'), F.upper("kind"), F.lit("]->(b);")).alias("line"))
    return n.unionByName(gap).unionByName(e)


def graphml(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession

    def fixed(part: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("ord"), F.lit(text).alias("line"))

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n<key id="kind" for="edge" attr.name="kind" attr.type="string"/>\n<graph edgedefault="directed">'

    def quoted(c):
        return F.replace(xml_escape(F.col(c)), F.lit('"'), F.lit("&quot;"))

    n = nodes_of(edges).select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit('<node id="'), quoted("id"), F.lit('"><data key="label">'), "label", F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\x01", "src", "kind", "dst").alias("ord"), F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('"><data key="kind">'), "kind", F.lit("</data></edge>")).alias("line"))
    return fixed(0, head).unionByName(n).unionByName(e).unionByName(fixed(3, "</graph>\n</graphml>"))


def dot(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession

    def fixed(part: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("ord"), F.lit(text).alias("line"))

    e = edges.select(F.lit(1).alias("part"), F.concat_ws("\x01", "src", "kind", "dst").alias("ord"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "kind", F.lit('"];')).alias("line"))
    return fixed(0, "digraph code {").unionByName(e).unionByName(fixed(2, "}"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines in order (part, ord); sorted by range, so files' order is the text's."""
    lines.orderBy("part", "ord").select("line").write.mode("overwrite").text(path)


def to_networkx(edges: DataFrame):
    """A networkx DiGraph (parallel edges collapse, the last kind stays); needs networkx."""
    import networkx

    g = networkx.DiGraph()
    for r in edges.orderBy("src", "dst", "kind").toLocalIterator():
        g.add_edge(r.src, r.dst, kind=r.kind)
    return g


def save_index(chunks: DataFrame, path: str, root: str, trace: bool = False) -> None:
    """One JSON object per line: a head, then chunks."""
    head = chunks.sparkSession.createDataFrame([(json.dumps({"version": 1, "root": root, "trace_api_calls": trace}),)], "value string")
    body = chunks.orderBy("chunk_ord").select(F.to_json(F.struct("chunk_ord", *FIELDS), {"ignoreNullFields": "false"}).alias("value"))
    head.unionByName(body).write.mode("overwrite").text(path)


def load_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings, chunks); graph and indices are rebuilt from the chunks."""
    rows = spark.read.text(path)
    is_head = F.get_json_object("value", "$.version").isNotNull()
    head = rows.where(is_head).first()
    if head is None:
        raise ValueError(f"no index in {path}")
    return json.loads(head.value), rows.where(~is_head).select(F.from_json("value", SCHEMA).alias("c")).select("c.*")


def load_json_export(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A one-object JSON index: {version, root, trace_api_calls, chunks: [...]}."""
    fields = SCHEMA.split("chunk_ord long, ", 1)[1]
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", f"version int, root string, trace_api_calls boolean, chunks array<struct<{fields.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>").alias("x"))
    head = df.select("x.version", "x.root", "x.trace_api_calls").first().asDict()
    return head, df.select(F.posexplode("x.chunks").alias("chunk_ord", "c")).select(F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.*")
