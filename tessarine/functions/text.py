"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = r"([A-Za-z_][A-Za-z0-9_]*)"
_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def split_identifier(name: Column) -> Column:
    """Lower-case parts of a snake_case or camelCase name."""
    spaced = F.regexp_replace(F.translate(name, "_", " "), _CAMEL, " ")
    return F.transform(F.filter(F.split(spaced, r"\s+"), lambda p: p != ""), F.lower)


def code_tokens(text: Column) -> Column:
    """Each identifier lower-cased, followed by its parts if it has several."""
    idents = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_IDENT), 1)
    return F.flatten(F.transform(idents, lambda w: F.concat(F.array(F.lower(w)), F.when(F.size(split_identifier(w)) > 1, split_identifier(w)).otherwise(F.array().cast("array<string>")))))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.char_length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def normalize_path(path: Column) -> Column:
    """A route: no query or host, parameters as ``*``, no outer slashes, lower case."""
    p = F.substring_index(path, "?", 1)
    p = F.regexp_replace(p, r"^https?://[^/]+", "")
    p = F.regexp_replace(p, r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", "*")
    return F.lower(F.regexp_replace(p, r"^/+|/+$", ""))


def module_names(path: Column) -> Column:
    """All dotted suffixes of a path without what follows its last dot, longest first; dots in folders part names too."""
    parts = F.split(F.regexp_replace(path, r"\.[^.]*$", ""), r"[./\\\\]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def node_label(node: Column) -> Column:
    return F.when(node.startswith("file:"), "File").otherwise("Chunk")


def cypher_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def xml_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def doc_summary(doc: Column) -> Column:
    return F.trim(F.coalesce(F.element_at(F.split(F.trim(F.coalesce(doc, F.lit(""))), "\n"), 1), F.lit("")))


def card(c=F.col) -> Column:
    """Id and kind, signature, summary if there is one, place."""
    s = doc_summary(c("docstring"))
    return F.concat_ws("\n", F.format_string("[%s]  (%s)", c("chunk_id"), c("kind")), F.concat(F.lit("    "), c("signature")), F.when(s != "", F.concat(F.lit('    """'), s, F.lit('"""'))), F.format_string("    @ %s:%d-%d", c("file"), c("start_line"), c("end_line")))


def search_text(c=F.col) -> Column:
    return F.concat_ws("\n", c("qualname"), c("signature"), F.coalesce(c("docstring"), F.lit("")), F.array_join(c("calls"), " "), c("file"))


def symbol_text(c=F.col) -> Column:
    return F.concat_ws(" ", c("name"), F.replace(c("qualname"), F.lit("."), F.lit(" ")), c("signature"), c("kind"), c("file"), c("language"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def surprisal(count: Column, total: Column, vocab: Column) -> Column:
    return -F.log((count + 1) / (total + vocab))


def unit(v: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    x = v.cast("array<double>")
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.transform(x, lambda e: e / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)
