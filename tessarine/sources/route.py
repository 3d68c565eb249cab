"""Which parser a file gets."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from . import brace, endblock, formats, python_source

_NAMES: dict[str, Callable] = {"makefile": formats.makefile, "gnumakefile": formats.makefile, "dockerfile": formats.dockerfile, "containerfile": formats.dockerfile, "cmakelists.txt": formats.cmake}
_HTML = frozenset(".html .htm .xhtml .xml .svg .vue .svelte .jinja .jinja2 .j2 .ejs .hbs .mustache .twig .liquid .njk .jsp .asp .aspx .cshtml .erb .tmpl".split())
_FORMATS: dict[str, Callable] = {
    **dict.fromkeys((".sh", ".bash", ".zsh", ".ksh"), formats.shell), **dict.fromkeys((".sql", ".ddl", ".psql"), formats.sql), ".mk": formats.makefile, ".dockerfile": formats.dockerfile,
    **dict.fromkeys((".md", ".markdown", ".mdx", ".rst"), formats.markdown), **dict.fromkeys((".yml", ".yaml", ".cff"), formats.yaml), **dict.fromkeys((".toml", ".ini", ".cfg", ".conf", ".properties", ".editorconfig"), formats.toml),
    **dict.fromkeys((".json", ".jsonc", ".json5", ".geojson"), formats.json_keys), ".cmake": formats.cmake, **dict.fromkeys((".tex", ".sty", ".cls"), formats.latex), **dict.fromkeys((".css", ".scss", ".sass", ".less"), formats.css),
}


def parser_for(path: str, source: str) -> Callable[[str, str], list[dict]]:
    """Never fails to name one: the last resort is generic."""
    name = os.path.basename(path).lower()
    ext = os.path.splitext(path)[1]
    if name in _NAMES or name.startswith(("dockerfile.", "makefile.")):
        return _NAMES.get(name) or _NAMES[name.split(".")[0]]
    if ext == ".m":
        if re.search(r"#import|@interface|@implementation", source[:4000]):
            return lambda f, s: brace.parse(f, s, brace.GRAMMARS[".mm"])
        return lambda f, s: endblock.parse(f, s, endblock.SPECS[".m"])
    if ext in _HTML:
        return formats.html
    if ext in brace.GRAMMARS:
        return lambda f, s: brace.parse(f, s, brace.GRAMMARS[ext])
    if ext in endblock.SPECS:
        return lambda f, s: endblock.parse(f, s, endblock.SPECS[ext])
    return _FORMATS.get(ext, formats.generic)


def parse_text(path: str, source: str) -> list[dict]:
    """All chunks of one text, whatever it looks like; a parser's error shows."""
    if path.lower().endswith(".py"):
        return python_source.parse(path, source)
    return parser_for(path, source)(path, source)


def looks_binary(source: str) -> bool:
    head = source[:8000]
    return "\0" in head or any(len(x) > 4000 for x in head.splitlines())


def parse_file(path: str, source: str) -> tuple[str, list[dict]]:
    """(status, chunks) of one file."""
    try:
        if not path.lower().endswith(".py") and looks_binary(source):
            return "skipped_binary", []
        return "indexed", parse_text(path, source)
    except Exception:  # one file's odd syntax must not end the scan; it is counted
        return "skipped_parse_error", []
