"""From chunks to typed edges: containment, calls, and calls across languages."""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import module_names, normalize_path
from ..runtime import broadcast_if_small

BUILTINS = sorted(dir(builtins))


def contains_edges(chunks: DataFrame) -> DataFrame:
    src = F.when(F.col("parent").isNotNull(), F.concat_ws("::", "file", "parent")).otherwise(F.concat(F.lit("file:"), "file"))
    return chunks.select(src.alias("src"), F.lit("contains").alias("kind"), F.col("chunk_id").alias("dst"))


def _first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def resolve_calls(chunks: DataFrame) -> DataFrame:
    """(chunk_ord, ref_ord, rule, src, kind, dst).

    Each reference is one row whose rule is the first that applies; a rule that
    applies but finds nothing ends the search, so rules never mix.
    1 self.x in a class: the class's own method.  2 a.b: b in the module a.
    3a bare name: the same file.  3b: the module it is imported from.
    3c: the one chunk anywhere of that name.  Self-edges are dropped.
    """
    defs = chunks.select("chunk_ord", "chunk_id", "name", "qualname", "file")
    mods = _first(chunks.select("file", "chunk_ord").groupBy("file").agg(F.min("chunk_ord").alias("o")).select("file", "o", F.explode(module_names(F.col("file"))).alias("module")), "module", "file", "o")
    order = chunks.groupBy("file").agg(F.min("chunk_ord").alias("o"))
    mods = mods.withColumnRenamed("file", "mod_file")
    by_end = mods.join(order, F.col("file") == F.col("mod_file")).select("mod_file", "o", F.explode(F.transform(F.sequence(F.lit(1), F.length("module")), lambda i: F.substr("module", i))).alias("end"))
    by_end = _first(by_end, "end", "mod_file", "o").withColumnRenamed("mod_file", "end_file")

    refs = chunks.where("kind <> 'class'").select("chunk_ord", F.col("chunk_id").alias("src"), "file", "parent", "imports", F.posexplode("calls").alias("ref_ord", "ref"))
    dot = F.instr("ref", ".")
    refs = refs.withColumn("prefix", F.when(dot > 0, F.expr("substring(ref, 1, instr(ref, '.') - 1)"))).withColumn("name", F.expr("substring(ref, instr(ref, '.') + 1)"))
    own = F.col("prefix").eqNullSafe("self") & F.col("parent").isNotNull()
    known = F.array_contains(F.array(*map(F.lit, BUILTINS)), F.col("name"))
    refs = refs.where(F.col("prefix").eqNullSafe("self") | ~known)
    imported = F.exists("imports", lambda i: (i == F.col("prefix")) | (F.substring_index(i, ".", 1) == F.col("prefix")))
    source = F.filter("imports", lambda i: i.contains(".") & (F.element_at(F.split(i, r"\."), -1) == F.col("name")))
    refs = refs.withColumn("from_full", F.regexp_replace(F.try_element_at(source, F.lit(-1)), r"\.?[^.]*$", "")).withColumn("from_import", F.size(source) > 0).withColumn("from_last", F.element_at(F.split("from_full", r"\."), -1)).withColumn("prefix_imported", imported)
    local = defs.select("file", "name").distinct().withColumn("local", F.lit(True))
    refs = refs.join(local, ["file", "name"], "left")
    kind = F.when(own, "1").when(F.col("prefix").isNotNull(), "2").when(F.col("local"), "3a").when(F.col("from_import"), "3b").otherwise("3c")
    refs = refs.withColumn("rule", kind)

    small_mods = broadcast_if_small(mods)
    r2 = refs.where("rule = '2'").join(small_mods, F.col("prefix") == F.col("module"), "left").drop("module")
    r2 = r2.join(by_end, F.when(F.col("mod_file").isNull() & F.col("prefix_imported"), F.col("prefix")) == F.col("end"), "left").withColumn("target", F.coalesce("mod_file", "end_file"))
    full, last = mods.select(F.col("module").alias("m1"), F.col("mod_file").alias("f1")), mods.select(F.col("module").alias("m2"), F.col("mod_file").alias("f2"))
    r3b = refs.where("rule = '3b'").join(full, F.col("from_full") == F.col("m1"), "left").join(last, F.col("from_last") == F.col("m2"), "left").withColumn("target", F.coalesce("f1", "f2"))
    cols = ["chunk_ord", "ref_ord", "rule", "src"]
    t = defs.select(F.col("file").alias("t_file"), F.col("name").alias("t_name"), F.col("chunk_id").alias("dst"))
    in_file = r2.select(*cols, "target", "name").unionByName(r3b.select(*cols, "target", "name")).unionByName(refs.where("rule = '3a'").select(*cols, F.col("file").alias("target"), "name"))
    named = in_file.join(t, (F.col("target") == F.col("t_file")) & (F.col("name") == F.col("t_name"))).select(*cols, "dst")
    qual = defs.groupBy("file", "qualname").agg(F.max_by("chunk_id", "chunk_ord").alias("dst"))
    methods = refs.where("rule = '1'").withColumn("qualname", F.concat_ws(".", "parent", "name")).join(qual, ["file", "qualname"]).select(*cols, "dst")
    unique = defs.groupBy("name").agg(F.count("*").alias("n"), F.min("chunk_id").alias("dst")).where("n = 1")
    alone = refs.where("rule = '3c'").join(unique, "name").select(*cols, "dst")
    return methods.unionByName(named).unionByName(alone).where("src <> dst").select("chunk_ord", "ref_ord", "rule", "src", F.lit("calls").alias("kind"), "dst")


def code_graph(chunks: DataFrame) -> DataFrame:
    return contains_edges(chunks).unionByName(resolve_calls(chunks).select("src", "kind", "dst"))


FRONTEND = (r"""fetch\(\s*["'`]([^"'`]+)["'`]""", r"""\b(?:http|axios)\.(?:delete|patch|put|post|get)(?:<[^>]*>)?\(\s*["'`]([^"'`]+)["'`]""", r"""\$\.ajax\(\s*\{[^}]*url\s*:\s*["'`]([^"'`]+)["'`]""")
BACKEND = (
    r"""@(?:router|app)\.(?:delete|patch|put|post|get|route)\(\s*[fr]?["']([^"']+)["']""",
    r"""\b(?:router|app)\.(?:delete|patch|put|post|get)\(\s*["'`]([^"'`]+)["'`]""",
    r"""\.HandleFunc\(\s*"([^"]+)\"""",
    r"""#\[(?:get|post|put|patch|delete)\(\s*"([^"]+)\"""",
    r"""\[(?:HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete|Route)\(\s*"([^"]+)\"""",
    r"""@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*"([^"]+)\"""",
)


def _paths(text, patterns):
    got = [F.regexp_extract_all(text, F.lit(p), 1) for p in patterns]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*got)), normalize_path), lambda p: p != ""))


def api_edges(chunks: DataFrame) -> DataFrame:
    """Clients' paths meet routes: one edge per pair that shares a path."""
    fe = chunks.select(F.col("chunk_id").alias("src"), F.explode(_paths(F.col("source"), FRONTEND)).alias("path"))
    whole = F.concat_ws("\n", F.array_join("decorators", "\n"), F.col("source"))
    be = chunks.select(F.col("chunk_id").alias("dst"), F.explode(_paths(whole, BACKEND)).alias("path"))
    return fe.join(be, "path").select("src", F.lit("api_calls").alias("kind"), "dst").distinct()


FFI = (
    r"""extern\s*"C"\s+[\w\s*]*?\b([A-Za-z_]\w*)\s*\(""",  # a prototype
    r"""\b(?:LibraryLoader|WinDLL|CDLL)\([^)]*\)\s*\.\s*([A-Za-z_]\w*)""",
    r"""\bFFI\(\)\.(?:def_extern|dlopen)\([^)]*\)\s*\.\s*([A-Za-z_]\w*)""",
)
_BLOCK = r"""extern\s*"C"\s*\{([^}]*)\}"""


def ffi_edges(chunks: DataFrame) -> DataFrame:
    """Names that a chunk declares in or calls through a foreign interface meet the C chunk that exports them."""
    inside = F.regexp_extract_all(F.array_join(F.regexp_extract_all("source", F.lit(_BLOCK), 1), "\n"), F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1)
    want = F.concat(inside, *[F.regexp_extract_all("source", F.lit(p), 1) for p in FFI])
    asks = chunks.select(F.col("chunk_id").alias("src"), F.explode(F.array_distinct(want)).alias("name"))
    gives = chunks.where(F.col("language").isin("c", "cpp", "objc")).where(F.array_contains(F.regexp_extract_all("source", F.lit(FFI[0]), 1), F.col("name")))
    gives = gives.groupBy("name").agg(F.max_by("chunk_id", "chunk_ord").alias("dst"))
    return asks.join(gives, "name").where("src <> dst").select("src", F.lit("ffi_calls").alias("kind"), "dst")


def rpc_edges(chunks: DataFrame) -> DataFrame:
    """x.Method( meets the implementation of a service's method; one edge per occurrence."""
    services = chunks.where("language = 'protobuf'").select("chunk_ord", F.regexp_extract_all("source", F.lit(r"service\s+(\w+)"), 1).alias("s"), F.regexp_extract_all("source", F.lit(r"\brpc\s+(\w+)"), 1).alias("m")).where(F.size("s") > 0)
    methods = services.select("chunk_ord", F.element_at("s", 1).alias("service"), F.explode("m").alias("name")).groupBy("name").agg(F.max_by("service", "chunk_ord").alias("service"))
    impl = chunks.where("kind = 'method'").select("name", "parent", "chunk_id", "chunk_ord").join(methods, "name").where(F.lower("parent").contains(F.lower("service"))).groupBy("name").agg(F.max_by("chunk_id", "chunk_ord").alias("dst"))
    uses = chunks.where("language <> 'protobuf'").select(F.col("chunk_id").alias("src"), F.explode(F.regexp_extract_all("source", F.lit(r"\.(\w+)\s*\("), 1)).alias("name"))
    return uses.join(impl, "name").where("src <> dst").select("src", F.lit("rpc_calls").alias("kind"), "dst")


def annotate(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.unionByName(api_edges(chunks)).unionByName(ffi_edges(chunks)).unionByName(rpc_edges(chunks))
