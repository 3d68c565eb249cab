"""Languages whose bodies stand in braces, from one grammar table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .chunk import called, chunk, comment_above, distinct, mask

_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|export|default|inline|extern|unsafe|const|partial|open|suspend|native|synchronized|readonly|declare|constexpr|explicit|friend|mutating|pub(?:\([^)]*\))?|fileprivate|data|inner|lateinit|external|operator|infix|tailrec|implicit|lazy|case|local)\s+)*"
_NOT_NAMES = frozenset("if for while switch catch return else do try new throw delete sizeof using foreach lock match when guard synchronized constructor defer select".split())
_ATTRIBUTE = re.compile(r"^\s*(@\w|#\[|\[\w)")


@dataclass(frozen=True)
class Grammar:
    """(kind, regex with a group ``name``, container?) rows, tried at each depth."""

    language: str
    rows: tuple
    imports: str = r"^\s*(?:import|#include|use|using|require)\b\s*(.+?);?\s*$"
    line_marks: tuple = ("//",)
    quotes: str = "\"'"
    verbatim: bool = False
    members: tuple = field(default=())


def _t(kind: str, word: str, container: bool = True) -> tuple:
    return kind, re.compile(rf"^[ \t]*{_MOD}(?:{word})\s+(?P<name>[A-Za-z_$][\w$.:]*)", re.M), container


def _f(pattern: str, kind: str = "function") -> tuple:
    return kind, re.compile(pattern, re.M), False


_C_FN = _f(rf"^[ \t]*{_MOD}(?:[\w:<>,\[\]~?.]++[\s*&]++)+(?P<name>~?[A-Za-z_$][\w$:]*)\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)")
_CTOR = _f(rf"^[ \t]*{_MOD}(?P<name>~?[A-Za-z_]\w*)\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)")
_FUN = lambda word: _f(rf"^[ \t]*{_MOD}(?:{word})\s+(?P<name>[A-Za-z_$][\w$.?!]*)")
_JS = (
    _t("class", "class"), _t("interface", "interface"), _t("enum", "enum", False), _t("namespace", "namespace|module"),
    _f(rf"^[ \t]*{_MOD}function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
    _f(rf"^[ \t]*{_MOD}(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
)
_JS_MEMBERS = (_f(rf"^[ \t]*{_MOD}(?:get\s+|set\s+|\*\s*)?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}=]*(?=\{{)"),)

GRAMMARS: dict[str, Grammar] = {}


def _add(exts: str, *a, **k) -> None:
    g = Grammar(*a, **k)
    for e in exts.split():
        GRAMMARS["." + e] = g


_TYPES = (_t("struct", "struct"), _t("enum", "enum", False))
_add("c h", "c", (_t("struct", r"(?:typedef\s+)?struct"), _t("enum", r"(?:typedef\s+)?enum", False), _C_FN))
_add("cpp cc cxx hpp hh hxx inl ipp tpp cu cuh", "cpp", (_t("namespace", "namespace"), _t("class", "class"), *_TYPES, _C_FN), members=(_CTOR,))
_add("cs", "csharp", (_t("namespace", "namespace"), _t("class", "class|record"), _t("interface", "interface"), *_TYPES, _C_FN), verbatim=True, members=(_CTOR,))
_add("java", "java", (_t("class", "class|record"), _t("interface", "@?interface"), _t("enum", "enum"), _C_FN), members=(_CTOR,))
_add("js mjs cjs jsx", "javascript", _JS, quotes="\"'`", members=_JS_MEMBERS)
_add("ts tsx mts cts", "typescript", (*_JS, _f(rf"^[ \t]*{_MOD}type\s+(?P<name>[A-Za-z_]\w*)[^=\n]*=\s*(?=\{{)", "type")), quotes="\"'`", members=_JS_MEMBERS)
_add("go", "go", (_f(r"^func\s+(?:\(\s*\w*\s*\*?(?P<receiver>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)"), _f(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct", "struct"), _f(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface", "interface")), quotes="\"`")
_add("rs", "rust", (_t("module", "mod"), _t("struct", "struct|union", False), _t("enum", "enum", False), _t("trait", "trait"), ("impl", re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", re.M), True), _FUN(r"(?:extern\s*(?:\"[^\"]*\")?\s*)?fn"), _f(r"^[ \t]*macro_rules!\s*(?P<name>\w+)", "macro")), quotes='"')
_add("php", "php", (_t("namespace", "namespace"), _t("class", "class"), _t("interface", "interface"), _t("trait", "trait"), _FUN("function")), line_marks=("//", "#"))
_add("swift", "swift", (_t("class", "class|actor"), _t("struct", "struct"), _t("enum", "enum"), _t("interface", "protocol"), _t("impl", "extension"), _FUN("func"), _f(r"^[ \t]*(?:\w+\s+)*(?P<name>init)\??\s*\([^{]*")), quotes='"')
_add("kt kts", "kotlin", (_t("class", r"(?:enum\s+|sealed\s+|annotation\s+)*class|object"), _t("interface", "interface"), _f(rf"^[ \t]*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>\w+)")), quotes='"')
_add("scala sc", "scala", (_t("class", "class|object"), _t("trait", "trait"), _FUN("def")), quotes='"')
_add("dart", "dart", (_t("class", "class|mixin|extension"), _t("enum", "enum", False), _C_FN), members=(_CTOR,))
_add("mm", "objc", (_f(r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)[^;{]*(?=\{)", "method"), _t("struct", r"(?:typedef\s+)?struct"), _C_FN))
_add("zig", "zig", (_f(r"^[ \t]*(?:pub\s+)?(?:inline\s+|export\s+)?fn\s+(?P<name>\w+)"), ("struct", re.compile(r"^[ \t]*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union|enum)", re.M), True)), quotes='"')
_add("groovy gradle", "groovy", (_t("class", "class"), _t("interface", "interface|trait"), _FUN("def"), _C_FN))
_add("pl pm", "perl", (_FUN("sub"), _t("module", "package", False)), line_marks=("#",))
_add("ps1 psm1", "powershell", (_f(r"(?i)^[ \t]*(?:function|filter)\s+(?P<name>[\w:-]+)"), _t("class", "class")), line_marks=("#",))
_add("r R", "r", (_f(r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\("),), line_marks=("#",))
_add("sol", "solidity", (_t("class", r"contract|library|abstract\s+contract"), _t("interface", "interface"), _t("struct", "struct", False), _FUN("function|modifier"), _f(r"^[ \t]*(?P<name>constructor)\s*\(")))
_add("d di", "d", (_t("class", "class"), _t("interface", "interface"), *_TYPES, _C_FN))
_add("proto", "protobuf", (_t("struct", "message"), _t("enum", "enum", False), _t("interface", "service"), _f(r"^[ \t]*rpc\s+(?P<name>\w+)\s*\([^;{]*", "method")))
_add("graphql gql", "graphql", (_t("type", r"(?:extend\s+)?(?:type|input)", False), _t("interface", "interface", False), _t("enum", "enum", False), _f(r"^[ \t]*(?:query|mutation|subscription|fragment)\s+(?P<name>\w+)")), line_marks=("#",))
_add("tf hcl tfvars", "terraform", (("struct", re.compile(r"^(?P<word>resource|data|module|variable|output|provider|locals|terraform)\b(?P<labels>[^{\n]*)", re.M), False),), line_marks=("#", "//"), quotes="")
EXTENSIONS = frozenset(GRAMMARS)


def _close(masked: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


def parse(file: str, source: str, g: Grammar) -> list[dict]:
    masked = mask(source, g.line_marks, quotes=g.quotes, verbatim=g.verbatim)
    lines = source.splitlines()
    starts = [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)

    def line_of(pos: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, pos) - 1

    imports = distinct((m.strip(" ;'\"<>()") for m in re.findall(g.imports, source, re.M)), 40)
    out: list[dict] = []

    def scan(a: int, b: int, parent: str | None, klass: bool) -> None:
        rows = (*g.rows, *(g.members if klass else ()))
        depth = [0]
        for c in masked[a:b]:
            depth.append(max(0, depth[-1] + (c == "{") - (c == "}")))
        found = []
        for order, (kind, rx, container) in enumerate(rows):
            for m in rx.finditer(masked, a, b):
                if depth[m.start() - a] == 0:
                    found.append((m.start(), order, kind, m, container))
        free = a
        for start, _, kind, m, container in sorted(found, key=lambda f: f[:2]):
            groups = m.groupdict()
            name = groups.get("name")
            if start < free:
                continue
            if name is None:
                labels = re.findall(r'"([^"]*)"|([\w.-]+)', source[m.start("labels") : m.end("labels")])
                name = ".".join([m["word"], *(x or y for x, y in labels)])
            if name in _NOT_NAMES:
                continue
            head = m.end()
            brace, semi = masked.find("{", head - (masked[head - 1 : head] == "{"), b), masked.find(";", head, b)
            if g.language in ("scala", "kotlin", "r") and not container:
                eol = masked.find("\n", head, b)
                eol = b if eol < 0 else eol
                if brace < 0 or brace > eol:
                    brace, semi = -1, eol
            if brace < 0 or 0 <= semi < brace:
                if kind in ("function", "class") and g.language not in ("scala", "kotlin", "r") or semi < 0:
                    if not (container and g.language == "csharp" and kind == "namespace"):
                        continue
                if container and kind == "namespace":  # to the end of the file
                    emit(kind, name, start, b - 1, m.end(), parent)
                    scan(semi + 1, b, name, False)
                    return
                end = semi
            else:
                end = _close(masked, brace)
                end = b - 1 if end < 0 else end
            receiver = groups.get("receiver")
            real = "method" if kind == "function" and (klass or receiver) else kind
            first = start + len(masked[start:head]) - len(masked[start:head].lstrip())
            emit(real, name, first, end, brace if 0 <= brace <= end else end, receiver or parent)
            if container and 0 <= brace < end:
                inner = f"{parent}.{name}" if parent else name
                scan(brace + 1, end, inner, kind not in ("namespace", "module"))
            free = end + 1

    def emit(kind: str, name: str, a: int, z: int, head_end: int, parent: str | None) -> None:
        first, last = line_of(a), min(line_of(z), len(lines) - 1)
        top = first
        marks = []
        while top > 0 and _ATTRIBUTE.match(lines[top - 1]):
            top -= 1
            marks.insert(0, lines[top].strip())
        body = masked[a : z + 1]
        name = name.rsplit("::", 1)[-1] if "::" in name and not name.startswith("~") else name
        out.append(chunk(file, lines, kind, name, first, last, g.language, parent=parent, signature=source[a:head_end], docstring=comment_above(lines, top, ("//", "*", "/*", "#")), decorators=marks, calls=called(body, name) if kind in ("function", "method") else (), imports=imports))

    scan(0, len(masked), None, False)
    return sorted(out, key=lambda c: c["start_line"])
