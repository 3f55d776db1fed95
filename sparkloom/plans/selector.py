"""CSS selectors: text to a syntax tree, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..html.errors import SelectorError

_WS = " \t\n\r\f"
_NAME = re.compile(r"[A-Za-z0-9_\-]*(?:[^\x00-\x7f][A-Za-z0-9_\-]*)*")
_OPERATORS = {"=": "exact", "~=": "word", "|=": "dash", "^=": "prefix", "$=": "suffix", "*=": "part"}
_COMBINATORS = {" ": "descendant", ">": "child", "+": "adjacent", "~": "sibling"}


def _starts_name(c: str) -> bool:
    return c.isascii() and c.isalpha() or c in "_-" or not c.isascii()


@dataclass(frozen=True)
class Simple:
    """kind: any, tag, id, class, attr, pseudo, not, is (also for where)."""

    kind: str
    name: str = ""
    op: str = ""
    value: str | None = None
    fold: bool = False
    inner: tuple = ()


@dataclass(frozen=True)
class Part:
    combinator: str | None
    simples: tuple[Simple, ...]


Selector = tuple[Part, ...]
Token = tuple[str, str | None]


_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n\r\f]?|(.))", re.S)


def _name(text: str, i: int, css: bool) -> tuple[str, int]:
    """A name at i and where it ends; with css, escapes count as what they stand for."""
    out = []
    while True:
        m = _NAME.match(text, i)
        out.append(m.group())
        i = m.end()
        m = _ESCAPE.match(text, i) if css else None
        if not m:
            return "".join(out), i
        code = int(m[1], 16) if m[1] else 0
        out.append(m[2] or (chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"))
        i = m.end()


def tokens(text: str, css: bool = False) -> list[Token]:
    """(kind, value) pairs, the last of kind end. css allows escapes, and white space in brackets."""
    out: list[Token] = []
    i, n, spaced, inside = 0, len(text), False, False
    while i < n:
        c = text[i]
        if c in _WS:
            spaced = True
            i += 1
            continue
        two = text[i : i + 2]
        if c in ">+" or c == "~" and two != "~=":
            out.append(("combinator", c))
            i += 1
            while i < n and text[i] in _WS:
                i += 1
            spaced = False
            continue
        if spaced and out and not (css and inside) and (c in "*#.[:" or _starts_name(c)):
            out.append(("combinator", " "))
        spaced = False
        if two in _OPERATORS and len(two) == 2:
            out.append(("operator", two))
            i += 2
        elif c in "#.":
            name, i = _name(text, i + 1, css)
            if not name:
                raise SelectorError(f"Empty {'ID' if c == '#' else 'class'} selector")
            out.append(("id" if c == "#" else "class", name))
        elif c in "\"'":
            i, value = i + 1, []
            while i < n and text[i] != c:
                if text[i] == "\\":
                    i += 1
                value.append(text[i : i + 1])
                i += 1
            if i >= n:
                raise SelectorError(f"Unterminated string in selector: {text!r}")
            out.append(("string", "".join(value)))
            i += 1
        elif c in "*[]=,:()":
            inside = c == "[" or inside and c != "]"
            out.append(("operator", "=") if c == "=" else (c, None))
            i += 1
        elif _starts_name(c) or css and c == "\\":
            name, i = _name(text, i, css)
            out.append(("name", name))
            if not name:
                raise SelectorError(f"Unexpected character in selector: {c!r}")
        elif c in "0123456789":
            m = re.compile(rf"[^{_WS}\])]*").match(text, i)
            out.append(("string", m.group()))
            i = m.end()
        else:
            raise SelectorError(f"Unexpected character in selector: {c!r}")
    return [*out, ("end", None)]


class _Parser:
    def __init__(self, text: str, css: bool):
        self.tokens, self.at = tokens(text, css), 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self) -> str | None:
        value = self.tokens[self.at][1]
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return value

    def expect(self, kind: str, message: str) -> str | None:
        if self.kind != kind:
            raise SelectorError(message)
        return self.take()

    def several(self, nested: bool) -> tuple[Selector, ...]:
        out = []
        while True:
            while nested and self.tokens[self.at] == ("combinator", " "):
                self.take()
            if nested and self.kind in ("end", ")"):
                break
            one = self.complex((",", ")") if nested else (",",))
            if one:
                out.append(one)
            if self.kind != ",":
                break
            self.take()
        if not out and not nested:
            raise SelectorError("Empty selector")
        return tuple(out)

    def complex(self, stops: tuple[str, ...]) -> Selector:
        """Compounds with their combinators; whatever cannot begin a compound ends it."""
        parts: list[Part] = []
        while True:
            how = _COMBINATORS[self.take()] if self.kind == "combinator" else None
            simples = self.compound()
            if not simples:
                break
            parts.append(Part(how if parts else None, simples))
            if self.kind == "end" or self.kind in stops:
                break
        return tuple(parts)

    def compound(self) -> tuple[Simple, ...]:
        out = []
        while True:
            kind = self.kind
            if kind == "*":
                self.take()
                out.append(Simple("any"))
            elif kind == "name":
                out.append(Simple("tag", _fold(self.take())))
            elif kind in ("id", "class"):
                out.append(Simple(kind, self.take()))
            elif kind == "[":
                out.append(self.attribute())
            elif kind == ":":
                out.append(self.pseudo())
            else:
                return tuple(out)

    def attribute(self) -> Simple:
        self.take()
        name = self.expect("name", "Expected attribute name")
        if self.kind == "]":
            self.take()
            return Simple("attr", name, "has")
        op = _OPERATORS[self.expect("operator", "Expected attribute operator or ]")]
        if self.kind not in ("string", "name"):
            raise SelectorError("Expected attribute value")
        value = self.take()
        while self.kind == "combinator":
            self.take()
        fold = self.tokens[self.at] in (("name", "i"), ("name", "I"))
        if fold:
            self.take()
        self.expect("]", "Expected ]")
        return Simple("attr", name, op, value, fold)

    def pseudo(self) -> Simple:
        self.take()
        name = _fold(self.expect("name", "Expected pseudo-class name"))
        if self.kind != "(":
            return Simple("pseudo", name)
        self.take()
        if name == "not":
            inner = (self.complex((",",)),)
            self.expect(")", "Expected ) in :not()")
            return Simple("not", inner=inner)
        if name in ("is", "where"):
            inner = self.several(True)
            self.expect(")", f"Expected ) in :{name}()")
            return Simple("is", inner=inner)
        depth, words = 1, []
        while depth and self.kind != "end":
            kind = self.kind
            depth += {"(": 1, ")": -1}.get(kind, 0)
            value = self.take()
            if depth:
                words.append(value if value is not None else kind if kind in "()" or name in ("has", "contains") else "")
        return Simple("pseudo", name, value="".join(words).strip())


def _fold(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def parse_selector(text: str, css: bool = False) -> tuple[Selector, ...]:
    """The selectors of a list. Raises SelectorError. css: as for tokens."""
    return _Parser(text, css).several(False)


def parse_nth(arg: str | None) -> tuple[int, int] | None:
    """(a, b) of An+B; None if it is none."""
    if arg is None:
        return None
    arg = _fold(arg.strip())
    known = {"odd": (2, 1), "even": (2, 0)}
    if arg in known:
        return known[arg]
    m = re.fullmatch(r"(?:(?P<a>[+-]?[0-9]*)(?P<n>n))?(?P<b>[+-]?[0-9]+)?", arg.replace(" ", ""))
    if not m or not arg or " " in arg and not m["n"]:
        return None
    a = 0 if not m["n"] else int({"": "1", "+": "1", "-": "-1"}.get(m["a"], m["a"]))
    b = int(m["b"] or 0)
    return (a, b) if max(abs(a), abs(b)) < 2**31 else None


def has_combinator(selectors: tuple[Selector, ...]) -> bool:
    """Whether more than the node itself must be looked at."""
    return any(len(s) > 1 or any(x.inner and has_combinator(x.inner) for p in s for x in p.simples) for s in selectors)
