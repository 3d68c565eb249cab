"""A sandboxed template language compiled to Python closures.

Text, ``{{ expression }}``, ``{# comment #}`` and the blocks ``for``, ``if`` /
``elif`` / ``else``, ``set`` and ``generation``.  Expressions know literals,
names, item access by ``.name`` or ``[...]`` (of dicts and lists alone, so no
attribute of a Python object can be reached), ``not``, ``and``, ``or``,
comparisons, ``in``, ``+``, ``~`` and ``| filter``.  Filters come from the
caller.  Constants fold when the template is compiled.  ``generation`` marks
what a model should learn: rendering gives the text and the marked spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.\[\]()<>,]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class Const:
    def __init__(self, value):
        self.value = value


class Op:
    """An expression: a function of the values of its parts."""

    def __init__(self, fn: Callable, *parts, pure: bool = True):
        self.fn, self.parts, self.pure = fn, parts, pure


class Name:
    def __init__(self, name: str):
        self.name = name


class Node:
    def __init__(self, kind: str, **parts):
        self.kind = kind
        self.__dict__.update(parts)


def _item(value, key):
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"no item {key!r}")


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class _Expression:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.i = 0

    def peek(self):
        return self.tokens[self.i][1] if self.i < len(self.tokens) and self.tokens[self.i][0] > 2 else None

    def take(self, want: str | None = None):
        if self.i >= len(self.tokens) or want and self.tokens[self.i][1] != want:
            raise TemplateError(f"expected {want or 'more'}")
        self.i += 1
        return self.tokens[self.i - 1]

    def parse(self):
        e = self.either()
        if self.i != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.peek() == "or":
            self.take()
            e = fold(Op(lambda a, b: a or b, e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self.peek() == "and":
            self.take()
            e = fold(Op(lambda a, b: a and b, e, self.negated()))
        return e

    def negated(self):
        if self.peek() == "not":
            self.take()
            return fold(Op(lambda a: not a, self.negated()))
        e = self.sum()
        while self.peek() in _COMPARE:
            e = fold(Op(_COMPARE[self.take()[1]], e, self.sum()))
        return e

    def sum(self):
        e = self.filtered()
        while self.peek() in ("+", "~"):
            sign = self.take()[1]
            e = fold(Op((lambda a, b: a + b) if sign == "+" else (lambda a, b: _text(a) + _text(b)), e, self.filtered()))
        return e

    def filtered(self):
        e = self.postfix()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            e = fold(Op(self.filters[name], e))
        return e

    def postfix(self):
        kind, value = self.take()
        if kind == 1:
            e = Const(int(value))
        elif kind == 2:
            e = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == 3:
            e = Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        elif value == "(":
            e = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, value = self.take()
                if kind != 3:
                    raise TemplateError("expected a name")
                key = Const(value)
            else:
                key = self.either()
                self.take("]")
            e = fold(Op(_item, e, key))
        return e


def fold(e):
    """An expression of constants is a constant."""
    if isinstance(e, Op) and e.pure and all(isinstance(p, Const) for p in e.parts):
        return Const(e.fn(*(p.value for p in e.parts)))
    return e


def parse(source: str, filters: Mapping[str, Callable]) -> list[Node]:
    """The syntax tree, with constants folded, dead branches cut, texts joined."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    pos = 0

    def expr(s: str):
        return _Expression(s, filters).parse()

    def block(ends: tuple[str, ...]) -> tuple[list[Node], str]:
        nonlocal pos
        nodes: list[Node] = []
        while pos < len(pieces):
            kind, body = pieces[pos]
            pos += 1
            if kind == "text":
                add(nodes, Node("text", text=body))
            elif kind == "out":
                e = expr(body)
                add(nodes, Node("text", text=_text(e.value)) if isinstance(e, Const) else Node("out", expr=e))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, body
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"can't read {body!r}")
                    inner, _ = block(("endfor",))
                    nodes.append(Node("for", name=m[1], expr=expr(m[2]), body=inner))
                elif word == "if":
                    for n in choice(rest):
                        add(nodes, n)
                elif word == "set":
                    name, _, value = rest.partition("=")
                    nodes.append(Node("set", name=name.strip(), expr=expr(value)))
                elif word == "generation":
                    inner, _ = block(("endgeneration",))
                    nodes.append(Node("generation", body=inner))
                else:
                    raise TemplateError(f"no tag {word!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return nodes, ""

    def choice(condition: str) -> list[Node]:
        test = expr(condition)
        yes, end = block(("elif", "else", "endif"))
        no: list[Node] = []
        if end.startswith("elif"):
            no = choice(end.partition(" ")[2])
        elif end == "else":
            no, _ = block(("endif",))
        if isinstance(test, Const):
            return yes if test.value else no
        return [Node("if", expr=test, yes=yes, no=no)]

    def add(nodes: list[Node], n: Node) -> None:
        if n.kind == "text":
            if not n.text:
                return
            if nodes and nodes[-1].kind == "text":
                nodes[-1] = Node("text", text=nodes[-1].text + n.text)
                return
        nodes.append(n)

    return block(())[0]


class Out:
    """What is rendered so far: texts, their length, marked spans."""

    __slots__ = ("texts", "size", "spans")

    def __init__(self):
        self.texts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)


def _value(e) -> Callable:
    if isinstance(e, Const):
        return lambda ctx, v=e.value: v
    if isinstance(e, Name):
        return lambda ctx, n=e.name: ctx.get(n)
    parts, fn = [_value(p) for p in e.parts], e.fn
    if len(parts) == 1:
        a = parts[0]
        return lambda ctx: fn(a(ctx))
    a, b = parts
    if fn is _item and isinstance(e.parts[1], Const):
        key = e.parts[1].value
        return lambda ctx: _item(a(ctx), key)
    return lambda ctx: fn(a(ctx), b(ctx))


def _closure(nodes: list[Node]) -> Callable:
    steps = [_step(n) for n in nodes]

    def run(ctx: dict, out: Out) -> None:
        for s in steps:
            s(ctx, out)

    return run


def _step(n: Node) -> Callable:
    if n.kind == "text":
        return lambda ctx, out, t=n.text: out.put(t)
    if n.kind == "generation":
        body = _closure(n.body)

        def marked(ctx, out):
            start = out.size
            body(ctx, out)
            out.spans.append((start, out.size))

        return marked
    value = _value(n.expr)
    if n.kind == "out":
        return lambda ctx, out: out.put(_text(value(ctx)))
    if n.kind == "set":
        return lambda ctx, out, name=n.name: ctx.__setitem__(name, value(ctx))
    if n.kind == "if":
        yes, no = _closure(n.yes), _closure(n.no)
        return lambda ctx, out: (yes if value(ctx) else no)(ctx, out)
    body, name = _closure(n.body), n.name

    def loop(ctx, out):
        for item in value(ctx) or ():
            body({**ctx, name: item}, out)

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        tree = parse(source, filters)
        self.run = _closure(tree)
        loops = [n for n in tree if n.kind == "for"]
        #: for ``{% for m in messages %}...{% endfor %}`` alone: one turn's closure
        self.turn, self.turn_name = (_closure(tree[0].body), tree[0].name) if len(tree) == len(loops) == 1 else (None, "")

    def render(self, **ctx) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        self.run(dict(ctx), out)
        return "".join(out.texts), out.spans

    def render_turn(self, message: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        self.turn({self.turn_name: message}, out)
        return "".join(out.texts), out.spans
