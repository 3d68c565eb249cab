"""Python files by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .chunk import distinct


def parse(file: str, source: str) -> list[dict]:
    """Top-level functions and classes, and classes' own methods; none if the file doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, imports, out = source.splitlines(), _imports(tree), []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_function(file, lines, node, None, imports))
        elif isinstance(node, ast.ClassDef):
            bases = ", ".join(ast.unparse(b) for b in [*node.bases, *node.keywords])
            out.append(_row(file, lines, node, "class", node.name, None, f"class {node.name}({bases}):" if bases else f"class {node.name}:", [], imports))
            out += [_function(file, lines, m, node.name, imports) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def _imports(tree: ast.Module) -> list[str]:
    got = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            got += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            got += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    return got


def _calls(node: ast.AST) -> list[str]:
    got = []
    for n in ast.walk(node):
        if not isinstance(n, ast.Call):
            continue
        f = n.func
        if isinstance(f, ast.Name):
            got.append(f.id)
        elif isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name):
                got.append(f"self.{f.attr}" if f.value.id in ("self", "cls") else f"{f.value.id}.{f.attr}")
            else:
                got.append(f.attr)
    return distinct(got)


def _function(file, lines, node, parent, imports) -> dict:
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return _row(file, lines, node, "method" if parent else "function", node.name, parent, f"{word} {node.name}({ast.unparse(node.args)}){back}:", _calls(node), imports)


def _row(file, lines, node, kind, name, parent, signature, calls, imports) -> dict:
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    qual = f"{parent}.{name}" if parent else name
    return {
        "chunk_id": f"{file}::{qual}", "kind": kind, "name": name, "qualname": qual, "file": file, "start_line": first, "end_line": node.end_lineno,
        "signature": signature, "docstring": ast.get_docstring(node), "source": "\n".join(lines[first - 1 : node.end_lineno]), "language": "python", "parent": parent,
        "decorators": [ast.unparse(d) for d in node.decorator_list], "calls": calls, "imports": imports,
    }
