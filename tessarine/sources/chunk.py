"""The chunk row and what all chunkers share."""

from __future__ import annotations

import re
from functools import lru_cache

FIELDS = ("chunk_id", "kind", "name", "qualname", "file", "start_line", "end_line", "signature", "docstring", "source", "language", "parent", "decorators", "calls", "imports")
SCHEMA = "chunk_ord long, chunk_id string, kind string, name string, qualname string, file string, start_line int, end_line int, signature string, docstring string, source string, language string, parent string, decorators array<string>, calls array<string>, imports array<string>"
CALL_LIMIT = 40
NOT_CALLS = frozenset("if for while switch catch return sizeof function func def fn new throw typeof elif else match case do with assert yield await lambda print echo and or not in is until unless when foreach using lock fixed synchronized super select defer go".split())
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
_WORD = re.compile(r"([A-Za-z_]\w*)\s*\(")
DATA_KINDS = frozenset("section key segment rule at_rule element style target stage table".split())


def distinct(items, limit: int | None = None) -> list[str]:
    out = list(dict.fromkeys(items))
    return out[:limit] if limit else out


def called(masked: str, own: str = "", dotted: bool = False) -> list[str]:
    """Names before an opening bracket, without keywords and the chunk's own name."""
    rx = _CALL if dotted else _WORD
    return distinct((m for m in rx.findall(masked) if m.rsplit(".", 1)[-1] not in NOT_CALLS and m != own), CALL_LIMIT)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def squeezed(text: str, size: int) -> str:
    """At least the first ``size`` characters of the squeezed text."""
    head = squeeze(text[: 4 * size])
    return head if len(head) >= size or len(text) <= 4 * size else squeeze(text)


def chunk(file: str, lines: list[str], kind: str, name: str, first: int, last: int, language: str, *, parent: str | None = None, qualname: str | None = None, signature: str | None = None, docstring: str | None = None, decorators=(), calls=(), imports=()) -> dict:
    """A chunk of lines first..last (0-based, both included)."""
    source = "\n".join(lines[first : last + 1])
    qual = qualname or (f"{parent}.{name}" if parent else name)
    sig = squeezed(signature if signature is not None else lines[first] if first < len(lines) else "", 161)
    if docstring is None and kind in DATA_KINDS:
        docstring = squeezed(source, 400)[:400]
    return {
        "chunk_id": f"{file}::{qual}", "kind": kind, "name": name, "qualname": qual, "file": file, "start_line": first + 1, "end_line": last + 1,
        "signature": sig if len(sig) <= 160 else sig[:159] + "…", "docstring": docstring, "source": source, "language": language, "parent": parent,
        "decorators": list(decorators), "calls": list(calls), "imports": list(imports),
    }


def number_repeats(chunks: list[dict]) -> list[dict]:
    """Later chunks of the same qualified name get #2, #3, ..."""
    seen: dict[str, int] = {}
    for c in chunks:
        n = seen[c["qualname"]] = seen.get(c["qualname"], 0) + 1
        if n > 1:
            c["qualname"] += f"#{n}"
            c["chunk_id"] = f"{c['file']}::{c['qualname']}"
    return chunks


@lru_cache(64)
def _special(line_marks: tuple, block_starts: tuple, quotes: str, triple: bool, verbatim: bool) -> re.Pattern:
    """Where a comment or a string may begin."""
    marks = [*line_marks, *block_starts, *quotes, *(('"""', "'''") if triple else ()), *(('@"',) if verbatim else ())]
    return re.compile("|".join(map(re.escape, marks)) or "(?!)")


def mask(src: str, line_marks=("//",), block_marks=(("/*", "*/"),), quotes="\"'`", triple: bool = False, verbatim: bool = False) -> str:
    """The source with comments and strings blanked; length and newlines stay."""
    n, i, done = len(src), 0, 0
    kept: list[str] = []

    def blank(start: int, stop: int) -> None:
        nonlocal done
        hidden = src[start : min(stop, n)]
        kept.append(src[done:start] + re.sub(r"[^\n]", " ", hidden))
        done = start + len(hidden)

    special = _special(tuple(line_marks), tuple(a for a, _ in block_marks), quotes, triple, verbatim)
    while i < n:
        at = special.search(src, i)
        if not at:
            break
        i = at.start()
        c = src[i]
        start = next((m for m in line_marks if src.startswith(m, i)), None)
        if start:
            j = src.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
            continue
        pair = next((p for p in block_marks if src.startswith(p[0], i)), None)
        if pair:
            j = src.find(pair[1], i + len(pair[0]))
            j = n if j < 0 else j + len(pair[1])
            blank(i, j)
            i = j
            continue
        if verbatim and src.startswith('@"', i):
            j = i + 2
            while j < n and not (src[j] == '"' and src[j + 1 : j + 2] != '"'):
                j += 2 if src[j] == '"' else 1
            blank(i, j + 1)
            i = j + 1
            continue
        if triple and src[i : i + 3] in ('"""', "'''"):
            j = src.find(src[i : i + 3], i + 3)
            j = n if j < 0 else j + 3
            blank(i, j)
            i = j
            continue
        if c in quotes:
            j = i + 1
            while j < n and src[j] != c and (src[j] != "\n" or c == "`"):
                j += 2 if src[j] == "\\" else 1
            j = min(n, j + (j < n and src[j] == c))
            blank(i, j)
            i = j
            continue
        i += 1
    return "".join(kept) + src[done:]


def comment_above(lines: list[str], at: int, marks=("#", "//", "--", "*", "/*", ";", "%", "!", "'"), limit: int = 600) -> str | None:
    """The comment lines right above a line, without their marks."""
    got = []
    i = at - 1
    while i >= 0:
        s = lines[i].strip()
        m = next((m for m in marks if s.startswith(m)), None)
        if not s or m is None:
            break
        got.append(s.strip("/*#-;%!' ").strip())
        i -= 1
    text = "\n".join(x for x in reversed(got) if x)
    return text[:limit] or None
