"""Languages whose bodies close with a word (end, fi, End Sub, ...)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .chunk import called, chunk, comment_above, mask


@dataclass(frozen=True)
class Ends:
    language: str
    declare: str  # groups kw (optional) and name
    end: str
    open_: str | None = None
    containers: tuple = ()
    marks: tuple = ("#",)
    flags: int = re.M


_RB_OPEN = r"^\s*(?:if|unless|while|until|case|begin|for|def|class|module)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$"
SPECS: dict[str, Ends] = {
    ".rb": Ends("ruby", r"^\s*(?P<kw>def|class|module)\s+(?P<name>(?:self\.)?[\w:?!=]+)", r"^\s*end\b", _RB_OPEN, ("class", "module")),
    ".lua": Ends("lua", r"^\s*(?:local\s+)?(?P<kw>function)\s+(?P<name>[\w.:]+)", r"^\s*end\b", r"^\s*(?:local\s+)?(?:function|if|for|while)\b|\bdo\s*$|=\s*function\b|\bfunction\s*\([^)]*\)\s*$", (), ("--",)),
    ".ex": Ends("elixir", r"^\s*(?:defmodule|(?P<kw>defp?|defmacro))\s+(?P<name>[\w.?!]+)", r"^\s*end\b", r"\bdo\s*$|\bfn\b.*->\s*$", ("",)),
    ".jl": Ends("julia", r"^\s*(?:module|(?:mutable\s+)?struct|(?P<kw>function|macro))\s+(?P<name>[\w.!]+)", r"^\s*end\b", r"^\s*(?:module|(?:mutable\s+)?struct|function|macro|if|for|while|begin|let|try|quote)\b|\bdo\b.*$", ("",)),
    ".cr": Ends("crystal", r"^\s*(?:private\s+|abstract\s+)?(?P<kw>def|class|module|struct)\s+(?P<name>(?:self\.)?[\w:?!]+)", r"^\s*end\b", _RB_OPEN, ("class", "module", "struct")),
    ".vb": Ends("vb", r"^\s*(?:(?:Public|Private|Friend|Shared|Overrides)\s+)*(?P<kw>Sub|Function|Class|Module|Structure|Interface)\s+(?P<name>\w+)", r"^\s*End\s+(?:Sub|Function|Class|Module|Structure|Interface)\b", r"^\s*(?:(?:Public|Private|Friend|Shared|Overrides)\s+)*(?:Sub|Function|Class|Module|Structure|Interface)\b", ("class", "module", "structure", "interface"), ("'",), re.M | re.I),
    ".fish": Ends("fish", r"^\s*(?P<kw>function)\s+(?P<name>[\w-]+)", r"^\s*end\b", r"^\s*(?:function|if|for|while|switch|begin)\b"),
    ".f90": Ends("fortran", r"^\s*(?:pure\s+|recursive\s+|elemental\s+)*(?:[\w()]+\s+)?(?P<kw>program|module|subroutine|function)\s+(?P<name>\w+)", r"^\s*end\s*(?:program|module|subroutine|function)\b", r"^\s*(?:pure\s+|recursive\s+|elemental\s+)*(?:[\w()]+\s+)?(?:program|module|subroutine|function)\s+\w+", ("module", "program"), ("!",), re.M | re.I),
    ".m": Ends("matlab", r"^\s*(?P<kw>function)\s+(?:[^=\n]*=\s*)?(?P<name>[\w.]+)", r"^\s*end\b", r"^\s*(?:function|if|for|while|switch|try|parfor)\b", (), ("%",)),
}
for _a, _b in ((".exs", ".ex"), (".f95", ".f90"), (".f03", ".f90"), (".f", ".f90"), (".bas", ".vb"), (".rake", ".rb")):
    SPECS[_a] = SPECS[_b]


def parse(file: str, source: str, spec: Ends) -> list[dict]:
    lines = source.splitlines()
    masked = mask(source, spec.marks, (), "\"'" if "'" not in spec.marks else '"').splitlines()
    declare, end = re.compile(spec.declare, spec.flags), re.compile(spec.end, spec.flags)
    opens = re.compile(spec.open_, spec.flags) if spec.open_ else None
    out: list[dict] = []

    def close(i: int) -> int:
        indent = len(masked[i]) - len(masked[i].lstrip())
        if opens:
            depth = 0
            for j in range(i, len(masked)):
                if end.search(masked[j]):
                    depth -= 1
                elif opens.search(masked[j]) and not re.search(r"\bend\b\s*$", masked[j]):
                    depth += 1
                if depth <= 0 and (j > i or end.search(masked[j]) is None):
                    return j
            return len(masked) - 1
        for j in range(i + 1, len(masked)):
            own = len(masked[j]) - len(masked[j].lstrip())
            if end.search(masked[j]) and own <= indent:
                return j
        return len(masked) - 1

    def scan(a: int, b: int, parent: str | None, kind_of: str | None) -> None:
        i = a
        while i <= b:
            m = declare.match(masked[i])
            if not m:
                i += 1
                continue
            kw = (m.groupdict().get("kw") or "").lower()
            last = min(close(i), b)
            box = kw in spec.containers
            kind = ("class" if kw == "" else kw) if box else "method" if parent and kind_of != "module" else "function"
            name = m["name"].removeprefix("self.")
            body = "\n".join(masked[i : last + 1])
            out.append(chunk(file, lines, kind, name, i, last, spec.language, parent=parent, docstring=comment_above(lines, i, spec.marks), calls=() if box else called(body, name, dotted=True)))
            if box:
                scan(i + 1, last - 1, f"{parent}.{name}" if parent else name, kind)
            i = last + 1

    scan(0, len(masked) - 1, None, None)
    return out
