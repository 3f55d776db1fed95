"""Selectors held against the nodes of one tree, without Spark's joins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from .. import constants as C
from ..options import ParseOptions
from ..plans.selector import Part, Selector, Simple, parse_nth, parse_selector
from .render import _all_text
from .tokenizer import lower
from .tree import DOCUMENT, ELEMENT, TEXT, Places, Tree, places

_BLANKS = re.compile(f"[{C.UNICODE_WS}]+")
_FORM = frozenset(("input", "select", "textarea"))
Test = Callable[[int], bool]


def nth(index: int | None, ab: tuple[int, int] | None) -> bool:
    if not index or ab is None:
        return False
    a, b = ab
    return index == b if a == 0 else (index - b) % a == 0 and (index - b) // a >= 0


def is_empty(t: Tree, i: int) -> bool:
    return not any(t.kind[c] == ELEMENT or t.kind[c] == TEXT and t.data[c].strip(C.UNICODE_WS) for c in t.children[i])


class Matcher:
    def __init__(self, t: Tree, options: ParseOptions = ParseOptions(), at: Places | None = None):
        self.t, self.options, self._at = t, options, at

    @property
    def at(self) -> Places:
        """Found out when a selector first asks for it."""
        if self._at is None:
            self._at = places(self.t)
        return self._at

    def _attribute(self, s: Simple) -> Test:
        t, fold = self.t, (lower if s.fold else lambda x: x)
        want = fold(s.value or "")
        if s.op == "has":
            return lambda i: t.has(i, s.name)
        tests: dict[str, Callable[[str], bool]] = {
            "exact": lambda v: v == want,
            "word": lambda v: want in [x for x in _BLANKS.split(v) if x],
            "dash": lambda v: v == want or v.startswith(want + "-"),
            "prefix": lambda v: v.startswith(want),
            "suffix": lambda v: v.endswith(want),
            "part": lambda v: want in v,
        }
        test = tests[s.op]
        return lambda i: (v := t.attr(i, s.name)) is not None and test(fold(v))

    def _pseudo(self, s: Simple) -> Test:
        t, name = self.t, s.name
        first = {
            "first-child": ("elem",), "last-child": ("elem_rev",), "only-child": ("elem", "elem_rev"),
            "first-of-type": ("same",), "last-of-type": ("same_rev",), "only-of-type": ("same", "same_rev"),
        }
        if name in first:
            columns = [getattr(self.at, x) for x in first[name]]
            return lambda i: all(x[i] == 1 for x in columns)
        counted = {"nth-child": "elem", "nth-last-child": "elem_rev", "nth-of-type": "same", "nth-last-of-type": "same_rev"}
        if name in counted:
            ab, places_ = parse_nth(s.value), getattr(self.at, counted[name])
            return lambda i: nth(places_[i], ab)
        with_attr = {"disabled": None, "checked": None, "required": _FORM, "read-only": _FORM - {"select"}, "placeholder-shown": _FORM - {"select"}}
        without = {"enabled": _FORM | {"button"}, "optional": _FORM, "read-write": _FORM - {"select"}}
        attr = {"enabled": "disabled", "optional": "required", "read-only": "readonly", "read-write": "readonly", "placeholder-shown": "placeholder"}.get(name, name)
        if name in with_attr:
            return lambda i: (with_attr[name] is None or t.name[i] in with_attr[name]) and t.has(i, attr)
        if name in without:
            return lambda i: t.name[i] in without[name] and not t.has(i, attr)
        if name == "empty":
            return lambda i: is_empty(t, i)
        if name == "root":
            return lambda i: t.parent[i] >= 0 and t.kind[t.parent[i]] == DOCUMENT
        if self.options.has_contains and name == "contains" and s.value is not None:
            return lambda i: s.value in _all_text(t, i)
        if self.options.has_contains and name == "has" and s.value:
            child = s.value.startswith(">")
            inner = [self.selector(x) for x in parse_selector(s.value, self.options.css_syntax)]
            return lambda i: any(t.kind[c] == ELEMENT and any(f(c) for f in inner) for c in (t.children[i] if child else t.walk(i)[1:]))
        return lambda i: False

    def _simple(self, s: Simple) -> Test:
        t = self.t
        if s.kind == "any":
            return lambda i: True
        if s.kind == "tag":
            return lambda i: t.name[i] == s.name  # names in the tree are in lower case
        if s.kind == "id":
            return lambda i: t.attr(i, "id") == s.name
        if s.kind == "class":
            return lambda i: (v := t.attr(i, "class")) is not None and s.name in _BLANKS.split(v)
        if s.kind == "attr":
            return self._attribute(s)
        if s.kind == "pseudo":
            return self._pseudo(s)
        inner = [self.selector(x) for x in s.inner]
        return (lambda i: not inner[0](i)) if s.kind == "not" else (lambda i: any(f(i) for f in inner))

    def _compound(self, part: Part) -> Test:
        tests = [self._simple(s) for s in part.simples]
        t = self.t
        return lambda i: t.kind[i] == ELEMENT and all(f(i) for f in tests)

    def _others(self, i: int, how: str) -> Iterator[int]:
        """Nodes that stand in the relation to i, nearest first."""
        t = self.t
        if how in ("child", "descendant"):
            up = t.parent[i]
            while up >= 0:
                yield up
                up = t.parent[up] if how == "descendant" else -1
            return
        before = self.at.prev[i]
        while before:
            yield before - 1
            before = self.at.prev[before - 1] if how == "sibling" else None

    def _nearest_sibling(self, test: Test) -> Callable[[int], int]:
        """The nearest earlier sibling that passes the test, or -1; siblings are looked at once."""
        t, known = self.t, {}

        def find(i: int) -> int:
            if i not in known:
                near = -1
                for c in t.children[t.parent[i]] if t.parent[i] >= 0 else (i,):
                    if t.kind[c] == ELEMENT:
                        known[c] = near
                        if test(c):
                            near = c
            return known[i]

        return find

    def selector(self, s: Selector) -> Test:
        """Without backtracking only the nearest node that fits counts for each part."""
        if not s:
            return lambda i: False
        tests = [self._compound(p) for p in s]
        every = self.options.backtracking
        siblings = {k: self._nearest_sibling(tests[k - 1]) for k in range(1, len(s)) if s[k].combinator not in ("child", "descendant", "adjacent")}

        def left(i: int, k: int) -> bool:
            while k:
                if every:
                    return any(left(x, k - 1) for x in self._others(i, s[k].combinator) if tests[k - 1](x))
                i = siblings[k](i) if k in siblings else next((x for x in self._others(i, s[k].combinator) if tests[k - 1](x)), -1)
                k -= 1
                if i < 0:
                    return False
            return True

        return lambda i: tests[-1](i) and left(i, len(s) - 1)

    def any(self, text: str) -> Test:
        tests = [self.selector(s) for s in parse_selector(text, self.options.css_syntax)]
        return lambda i: any(f(i) for f in tests)

    def query_all(self, text: str, root: int = 0, first: bool = False) -> list[int]:
        parsed = parse_selector(text, self.options.css_syntax)
        tags = [next((x.name for x in p[-1].simples if x.kind == "tag"), None) if p else None for p in parsed]
        some = self.t.walk(root)
        if None not in tags:  # most elements are no candidates by their names
            wanted, names = frozenset(tags), self.t.name
            some = [i for i in some if names[i] in wanted]
        test, out = self.any(text), []
        for i in some:
            if self.t.kind[i] == ELEMENT and test(i):
                out.append(i)
                if first:
                    break
        return out
