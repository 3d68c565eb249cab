"""Markup, data and build formats, and a generic chunker for the rest."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .chunk import called, chunk, comment_above, mask, number_repeats, squeeze

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SEMANTIC = frozenset("header nav main article section aside footer form template dialog".split())
_HTML_KINDS = {"script": "script", "style": "style", "form": "form", "template": "template"}


class _Collector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[tuple] = []
        self.closed: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append((tag, dict(attrs), self.getpos()[0]))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            name, attrs, line = self.open[at]
            del self.open[at:]
            self.closed.append((name, attrs, line, self.getpos()[0]))


def html(file: str, source: str) -> list[dict]:
    """Closed elements with an id, landmarks, scripts and styles."""
    lines, c = source.splitlines(), _Collector()
    c.feed(source)
    c.close()
    out, seen = [], set()
    for tag, attrs, a, z in sorted(c.closed, key=lambda e: (e[2], -e[3])):
        if not (attrs.get("id") or tag in _SEMANTIC or tag in _HTML_KINDS):
            continue
        name = f"{tag}#{attrs['id']}" if attrs.get("id") else attrs.get("src") or f"{tag}@L{a}"
        if name in seen:
            name += f"@L{a}"
        seen.add(name)
        body = "\n".join(lines[a - 1 : z])
        out.append(chunk(file, lines, _HTML_KINDS.get(tag, "element"), name, a - 1, min(z, len(lines)) - 1, "html", docstring=attrs.get("title") or attrs.get("aria-label"), calls=called(mask(body)) if tag == "script" else ()))
    return out


def css(file: str, source: str) -> list[dict]:
    """One chunk per rule; media, supports, layer and container rules recurse."""
    text, lines, out = mask(source, (), (("/*", "*/"),), ""), source.splitlines(), []

    def scan(a: int, b: int, parent: str | None) -> None:
        at = a
        while (brace := text.find("{", at, b)) >= 0:
            head = text[at:brace]
            start = at + max(head.rfind("}"), head.rfind(";")) + 1
            selector = squeeze(text[start:brace])
            depth, end = 1, brace + 1
            while end < b and depth:
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            start += len(text[start:brace]) - len(text[start:brace].lstrip())
            props = re.findall(r"(?:^|[;{])\s*([\w-]+)\s*:", text[brace:end])
            kind = "at_rule" if selector.startswith("@") else "rule"
            out.append(chunk(file, lines, kind, selector[:60], source.count("\n", 0, start), source.count("\n", 0, max(brace, end - 1)), "css", parent=parent, signature=selector, calls=list(dict.fromkeys(props))[:30]))
            if re.match(r"@(media|supports|layer|container)\b", selector):
                scan(brace + 1, end - 1, selector[:60])
            at = end

    scan(0, len(text), None)
    return number_repeats(out)


def shell(file: str, source: str) -> list[dict]:
    lines, text = source.splitlines(), mask(source, ("#",), ())
    out = []
    for m in re.finditer(r"^[ \t]*(?:function\s+(?P<a>[\w:-]+)\s*(?:\(\s*\))?|(?P<b>[\w:-]+)\s*\(\s*\))\s*\{", text, re.M):
        depth, end = 0, m.end() - 1
        for end in range(m.end() - 1, len(text)):
            depth += (text[end] == "{") - (text[end] == "}")
            if depth == 0:
                break
        first = source.count("\n", 0, m.start())
        name = m["a"] or m["b"]
        words = re.findall(r"(?:^|[;&|(`]|\bthen|\bdo)\s*([A-Za-z_][\w-]*)", text[m.end() : end], re.M)
        out.append(chunk(file, lines, "function", name, first, source.count("\n", 0, end), "shell", docstring=comment_above(lines, first), calls=[w for w in dict.fromkeys(words) if w != name][:40]))
    return out


def sql(file: str, source: str) -> list[dict]:
    """CREATE statements up to their semicolon."""
    text, lines, out = mask(source, ("--",), (("/*", "*/"), ("$$", "$$")), "'"), source.splitlines(), []
    for m in re.finditer(r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNIQUE|MATERIALIZED|EXTERNAL)\s+)*(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|INDEX|SEQUENCE|TYPE|SCHEMA|DATABASE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`\[\]]+)", text):
        end = text.find(";", m.end())
        end = len(text) - 1 if end < 0 else end
        first = source.count("\n", 0, m.start())
        out.append(chunk(file, lines, m[1].lower(), m[2].strip('"`[]'), first, source.count("\n", 0, end), "sql", docstring=comment_above(lines, first, ("--", "/*", "*"))))
    return number_repeats(out)


def _spans(lines: list[str], heads: list[int]) -> list[tuple[int, int]]:
    """From each head to before the next, blank lines at the end cut off."""
    out = []
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        while b - 1 > a and not lines[b - 1].strip():
            b -= 1
        out.append((a, b - 1))
    return out


def makefile(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    heads = [(i, m[1]) for i, x in enumerate(lines) if (m := re.match(r"([A-Za-z0-9_][\w./%-]*)(?:\s+[\w./%-]+)*\s*:(?!=)", x))]
    return [chunk(file, lines, "target", n, a, b, "makefile", docstring=comment_above(lines, a)) for (_, n), (a, b) in zip(heads, _spans(lines, [i for i, _ in heads]))]


def dockerfile(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    heads = [(i, m[1]) for i, x in enumerate(lines) if (m := re.match(r"(?i)\s*FROM\s+\S+(?:\s+AS\s+(\S+))?", x))]
    if not heads:
        return [chunk(file, lines, "stage", "Dockerfile", 0, len(lines) - 1, "dockerfile")] if lines else []
    return [chunk(file, lines, "stage", n or f"stage{k}", a, b, "dockerfile") for k, ((_, n), (a, b)) in enumerate(zip(heads, _spans(lines, [i for i, _ in heads])), 1)]


def markdown(file: str, source: str) -> list[dict]:
    """Sections from one heading to the next of any level."""
    lines, heads, fenced = source.splitlines(), [], False
    for i, x in enumerate(lines):
        if x.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", x)):
            heads.append((i, len(m[1]), m[2]))
    if not heads:
        return [chunk(file, lines, "section", file.rsplit("/", 1)[-1], 0, len(lines) - 1, "markdown")] if lines else []
    out, stack = [], []
    for (i, level, title), end in zip(heads, [*(h[0] for h in heads[1:]), len(lines)]):
        while stack and stack[-1][0] >= level:
            stack.pop()
        up = " > ".join(t for _, t in stack)
        out.append(chunk(file, lines, "section", title, i, end - 1, "markdown", parent=up or None, qualname=f"{up} > {title}" if up else title))
        stack.append((level, title))
    return number_repeats(out)


def yaml(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    heads = [(i, m[1].strip("\"'")) for i, x in enumerate(lines) if (m := re.match(r"([A-Za-z0-9_.\"'/-][^:#]*?)\s*:(?:\s|$)", x))]
    return number_repeats([chunk(file, lines, "key", n, a, b, "yaml") for (_, n), (a, b) in zip(heads, _spans(lines, [i for i, _ in heads]))])


def toml(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    heads = [(i, m[1].strip()) for i, x in enumerate(lines) if (m := re.match(r"\s*\[+([^\[\]]+)\]+\s*(?:[#;].*)?$", x))]
    if not heads:
        return [chunk(file, lines, "section", file.rsplit("/", 1)[-1], 0, len(lines) - 1, "toml")] if lines else []
    out = [chunk(file, lines, "section", n, a, b, "toml") for (_, n), (a, b) in zip(heads, _spans(lines, [i for i, _ in heads]))]
    if any(x.strip() for x in lines[: heads[0][0]]):
        out.insert(0, chunk(file, lines, "section", "(top)", 0, heads[0][0] - 1, "toml"))
    return number_repeats(out)


def json_keys(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    keys = [(i, len(m[1].expandtabs(4)), m[2]) for i, x in enumerate(lines) if (m := re.match(r'([ \t]{1,4})"((?:[^"\\]|\\.)*)"\s*:', x))]
    if not keys:
        return [chunk(file, lines, "section", file.rsplit("/", 1)[-1], 0, len(lines) - 1, "json")] if lines else []
    least = min(k[1] for k in keys)
    heads = [(i, n) for i, d, n in keys if d == least]
    return number_repeats([chunk(file, lines, "key", n, a, b, "json") for (_, n), (a, b) in zip(heads, _spans(lines, [i for i, _ in heads]))])


def cmake(file: str, source: str) -> list[dict]:
    lines, out, covered = source.splitlines(), [], set()
    for i, x in enumerate(lines):
        if m := re.match(r"(?i)\s*(function|macro)\s*\(\s*(\w+)", x):
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"(?i)\s*end{m[1]}\b", lines[j])), len(lines) - 1)
            covered |= set(range(i, end + 1))
            body = "\n".join(lines[i : end + 1])
            out.append(chunk(file, lines, m[1].lower(), m[2], i, end, "cmake", docstring=comment_above(lines, i), calls=called(mask(body, ("#",), ()), m[2], dotted=True)))
    rest = [i for i, x in enumerate(lines) if x.strip() and i not in covered]
    if rest:
        out.insert(0, chunk(file, lines, "section", "(top)", rest[0], rest[-1], "cmake"))
    return out


_TEX = {n: i for i, n in enumerate(("part", "chapter", "section", "subsection", "subsubsection"))}


def latex(file: str, source: str) -> list[dict]:
    lines = source.splitlines()
    heads = [(i, _TEX[m[1]], m[2]) for i, x in enumerate(lines) if (m := re.match(r"\s*\\(part|chapter|section|subsection|subsubsection)\*?(?:\[[^\]]*\])?\{([^}]*)\}", x))]
    if not heads:
        return [chunk(file, lines, "section", file.rsplit("/", 1)[-1], 0, len(lines) - 1, "latex")] if lines else []
    out, stack = [], []
    for (i, level, title), (a, b) in zip(heads, _spans(lines, [h[0] for h in heads])):
        while stack and stack[-1][0] >= level:
            stack.pop()
        up = " > ".join(t for _, t in stack)
        out.append(chunk(file, lines, "section", title, a, b, "latex", parent=up or None, qualname=f"{up} > {title}" if up else title))
        stack.append((level, title))
    return number_repeats(out)


_DECLARE = (
    re.compile(r"^\s*(?:[\w@]+\s+)*?(?P<kw>function|func|fun|fn|def|sub|proc|procedure|method|macro|defn-?|define|let\s+rec|let)\s+(?P<name>[A-Za-z_][\w?!*'-]*)"),
    re.compile(r"^\s*(?:[\w@]+\s+)*?(?P<kw>class|struct|module|interface|trait|type|enum|record|object|namespace|package|protocol|union)\s+(?P<name>[A-Za-z_][\w.-]*)"),
    re.compile(r"^\s*\((?P<kw>defun|defmacro|defn|define|defmethod)\s+\(?(?P<name>[^\s()]+)"),
    re.compile(r"^(?P<name>[a-z]\w*)\s*\([^)]*\)\s*(?:when[^>]*)?->"),
    re.compile(r"^\s*(?P<name>[A-Za-z_]\w*)\s*(?:=|:=)\s*(?:function|func|fn|lambda|\\)\b"),
)
_FUNCTIONS = frozenset("function func fun fn def sub proc procedure method macro defn defn- define let defun defmacro defmethod".split())
_STYLES = (("//",), ("#",), ("--",), (";",), ("%",), ("!",), ("'",))


def generic(file: str, source: str, size: int = 40) -> list[dict]:
    """Declarations by their keywords; files without any in runs of 40 lines."""
    lines = source.splitlines()
    if not lines:
        return []
    ext = file.rsplit(".", 1)[-1].lower() if "." in file else "text"
    tally = [sum(x.lstrip().startswith(s) for x in lines[:400]) for s in _STYLES]
    marks = _STYLES[tally.index(max(tally))] if max(tally) else ("//", "#")
    masked = mask(source, marks, (("/*", "*/"),) if marks == ("//",) else (), '"').splitlines()
    masked += [""] * (len(lines) - len(masked))
    out, i = [], 0
    while i < len(lines):
        m = next((m for rx in _DECLARE if (m := rx.match(masked[i]))), None)
        if not m:
            i += 1
            continue
        kw = (m.groupdict().get("kw") or "function").split()[0]
        end = _generic_end(masked, i)
        kind = "function" if kw in _FUNCTIONS else kw
        body = "\n".join(masked[i : end + 1])
        out.append(chunk(file, lines, kind, m["name"], i, end, ext, docstring=comment_above(lines, i, marks), calls=called(body, m["name"], dotted=True)))
        i = end + 1 if kind == "function" else i + 1
    if not out:
        return [chunk(file, lines, "segment", f"L{a + 1}-{min(a + size, len(lines))}", a, min(a + size, len(lines)) - 1, ext) for a in range(0, len(lines), size)]
    return number_repeats(out)


def _generic_end(masked: list[str], i: int) -> int:
    depth = 0
    for j in range(i, len(masked)):
        depth += masked[j].count("{") - masked[j].count("}")
        if "{" in masked[j] or depth:
            if depth <= 0:
                return j
        elif j > i + 2:
            break
    if depth > 0:
        return len(masked) - 1
    indent = len(masked[i]) - len(masked[i].lstrip())
    last = i
    for j in range(i + 1, len(masked)):
        if not masked[j].strip():
            continue
        own = len(masked[j]) - len(masked[j].lstrip())
        if own <= indent:
            return j if re.match(r"\s*end\b", masked[j]) and own == indent else last
        last = j
    return last
