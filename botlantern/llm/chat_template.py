"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for m in messages %} ... {% endfor %}   {# comment #}
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

Expressions: strings, whole numbers, true, false, none, names, items (m.role, m['role']), ==, !=,
not, and, or, joining (~), parentheses, and filters (x | escape). There are no calls, no attributes
of objects and no names but those given, so a template reaches nothing else.

A template is parsed into a tree, constants are folded (constant expressions, branches that can't
be taken, neighbouring texts), and each node becomes a closure that yields (text, generated)
pieces. Loops take their values one by one, so a conversation is never held whole; loop.first,
loop.last and loop.index0 are known in a loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

Piece = tuple[str, bool]
#: Comes after each round of a loop, told by identity; it has no text.
BREAK: Piece = ("", False)


class TemplateError(ValueError):
    pass


# --- escaping -----------------------------------------------------------------------------

#: The strings that mark turns.
OPEN, CLOSE = "###", "</turn>"
_CONTROL = re.compile(rf"(?=\\|{re.escape(OPEN)}|{re.escape(CLOSE)})")
_HEADER = re.compile(rf"(?=\\|{re.escape(OPEN)}|{re.escape(CLOSE)}|:)")


def escape(text: str) -> str:
    """A backslash before each backslash and each place where a control string begins."""
    return _CONTROL.sub(r"\\", text)


def escape_header(text: str) -> str:
    return _HEADER.sub(r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": escape_header, "upper": str.upper, "lower": str.lower, "trim": str.strip}

# --- the tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]()|~]))""")
_LITERALS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """A parser by descent: or, and, not, comparison, join, filter, item."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] != "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self):
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take("==", "!="):
            left = Op(op, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.take("~"):
            left = Op("~", (left, self.filtered()))
        return left

    def filtered(self):
        left = self.item()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = Op("|" + name, (left,))
        return left

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def item(self):
        kind, token = self.next()
        if kind == "string":
            left = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        elif kind == "int":
            left = Const(int(token))
        elif kind == "name":
            left = Const(_LITERALS[token]) if token in _LITERALS else Name(token)
        elif token == "(":
            left = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {token!r}")
        while op := self.take(".", "["):
            kind, key = self.next()
            if op == "[":
                if kind != "string":
                    raise TemplateError("a key in quotes expected")
                key = key[1:-1]
                self.need("]")
            left = Item(left, key)
        return left


def parse(source: str) -> tuple:
    """The tree of a template."""
    parts = iter(_TAG.split(source))

    def body(*ends: str) -> tuple[tuple, str]:
        nodes: list = []
        for part in parts:
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(Output(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(nodes), f"{word} {rest}".strip()
                nodes.append(block(word, rest))
            elif part:
                nodes.append(Text(part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def block(word: str, rest: str):
        if word == "for":
            if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                raise TemplateError(f"can't read: for {rest}")
            return For(m[1], _Expression(m[2]).whole(), body("endfor")[0])
        if word == "generation":
            return Generation(body("endgeneration")[0])
        if word == "if":
            branches, test = [], rest
            while True:
                nodes, end = body("elif", "else", "endif")
                branches.append((_Expression(test).whole(), nodes))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    branches.append((Const(True), body("endif")[0]))
                    return If(tuple(branches))
                test = end.partition(" ")[2]
        raise TemplateError(f"no block {word!r}")

    return body()[0]


# --- folding ------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _apply(kind: str, args: list) -> Any:
    if kind == "not":
        return not args[0]
    if kind == "==":
        return args[0] == args[1]
    if kind == "!=":
        return args[0] != args[1]
    if kind == "~":
        return _text(args[0]) + _text(args[1])
    return FILTERS[kind[1:]](_text(args[0]))


def fold_expression(e: Any) -> Any:
    if isinstance(e, Item):
        return Item(fold_expression(e.of), e.key)
    if not isinstance(e, Op):
        return e
    args = [fold_expression(a) for a in e.args]
    if e.kind in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
    elif all(isinstance(a, Const) for a in args):
        return Const(_apply(e.kind, [a.value for a in args]))
    return Op(e.kind, tuple(args))


def fold(nodes: Iterable) -> tuple:
    """The same template with constants folded."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output):
            value = fold_expression(node.value)
            node = Text(_text(value.value)) if isinstance(value, Const) else Output(value)
        elif isinstance(node, For):
            node = For(node.name, fold_expression(node.over), fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, If):
            branches = []
            for test, body in node.branches:
                test = fold_expression(test)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if not branches or isinstance(branches[0][0], Const):
                extra = branches[0][1] if branches else ()
            else:
                extra = (If(tuple(branches)),)
            for x in extra:
                _append(out, x)
            continue
        _append(out, node)
    return tuple(out)


def _append(out: list, node: Any) -> None:
    if isinstance(node, Text) and out and isinstance(out[-1], Text):
        out[-1] = Text(out[-1].text + node.text)
    elif not (isinstance(node, Text) and not node.text):
        out.append(node)


# --- closures -----------------------------------------------------------------------------


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda names: e.value
    if isinstance(e, Name):

        def named(names: dict) -> Any:
            if e.name not in names:
                raise TemplateError(f"no name {e.name!r}")
            return names[e.name]

        return named
    if isinstance(e, Item):
        of = _value(e.of)

        def item(names: dict) -> Any:
            owner = of(names)
            if not isinstance(owner, dict):
                raise TemplateError(f"no items in what {e.key!r} is asked of")
            return owner.get(e.key)

        return item
    args = [_value(a) for a in e.args]
    if e.kind == "and":
        return lambda names: args[0](names) and args[1](names)
    if e.kind == "or":
        return lambda names: args[0](names) or args[1](names)
    return lambda names: _apply(e.kind, [a(names) for a in args])


def _closure(nodes: tuple, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    runs = [_node(n, generated) for n in nodes]

    def run(names: dict) -> Iterator[Piece]:
        for r in runs:
            yield from r(names)

    return run


def _node(node: Any, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        piece = (node.text, generated)
        return lambda names: iter((piece,))
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda names: iter(((_text(value(names)), generated),))
    if isinstance(node, Generation):
        return _closure(node.body, True)
    if isinstance(node, If):
        branches = [(_value(t), _closure(b, generated)) for t, b in node.branches]

        def choose(names: dict) -> Iterator[Piece]:
            for test, body in branches:
                if test(names):
                    yield from body(names)
                    return

        return choose
    over, body = _value(node.over), _closure(node.body, generated)

    def loop(names: dict) -> Iterator[Piece]:
        index, rest = 0, iter(over(names) or ())
        value = next(rest, _END)
        while value is not _END:
            after = next(rest, _END)
            yield from body(names | {node.name: value, "loop": {"index0": index, "first": index == 0, "last": after is _END}})
            yield BREAK
            index, value = index + 1, after

    return loop


_END = object()


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, generated) pieces."""
    run = _closure(fold(parse(source)), False)
    return lambda **names: run(names)
