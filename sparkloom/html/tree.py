"""Tokens to a tree of nodes.

A tree is a set of parallel lists, one entry a node in the order of creation; node i has the id i + 1. What a tag does in
the body is looked up in tables: most start tags differ only in whether they close a paragraph first, whether they
stay open, and whether they count as formatting.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass, field

from .. import constants as C
from ..options import ParseOptions
from .errors import ParseError
from .tokenizer import CHARS, COMMENT, DOCTYPE, END, RAWTEXT, RCDATA, START, Token, Tokenizer

DOCUMENT, FRAGMENT, DOCTYPE_NODE, ELEMENT, TEXT, COMMENT_NODE = "document", "fragment", "doctype", "element", "text", "comment"
NODE_NAMES = {DOCUMENT: "#document", FRAGMENT: "#document-fragment", DOCTYPE_NODE: "!doctype", TEXT: "#text", COMMENT_NODE: "#comment"}


@dataclass
class Tree:
    kind: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    attrs: list[list[tuple[str, str | None]] | tuple] = field(default_factory=list)
    data: list[str | None] = field(default_factory=list)
    doctype: dict[int, tuple[str | None, str | None, str | None, bool]] = field(default_factory=dict)
    namespace: dict[int, str] = field(default_factory=dict)
    parent: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def add(self, kind: str, parent: int, name: str | None = None, attrs: list | None = None, data: str | None = None) -> int:
        i = len(self.kind)
        self.kind.append(kind)
        self.name.append(NODE_NAMES[kind] if name is None else name)
        self.attrs.append(attrs or ())
        self.data.append(data)
        self.parent.append(parent)
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(i)
        return i

    def attr(self, i: int, name: str) -> str | None:
        return next((v for k, v in self.attrs[i] if k == name), None)

    def has(self, i: int, name: str) -> bool:
        return any(k == name for k, _ in self.attrs[i])

    def walk(self, root: int = 0) -> list[int]:
        """root and its descendants in document order."""
        out, todo = [], [root]
        while todo:
            i = todo.pop()
            out.append(i)
            todo.extend(reversed(self.children[i]))
        return out


# What a start tag does in the body: P closes an open paragraph, V leaves the element closed, F marks formatting.
_P, _V = 1, 2
_BODY_START: dict[str, int] = dict.fromkeys(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p "
    "search section summary ul pre listing dd dt plaintext table h1 h2 h3 h4 h5 h6 li form".split(), _P
)
_BODY_START |= dict.fromkeys("area br embed img keygen wbr input".split(), _V)
_BODY_START["hr"] = _P | _V
_HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title".split())
_HEAD_VOID = frozenset("base basefont bgsound link meta".split())
_HEAD_TEXT = frozenset("title noframes style script".split())
_SCOPED_END = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu "
    "nav ol pre search section summary ul applet marquee object".split()
)
_SPECIAL_START = frozenset("html body frameset h1 h2 h3 h4 h5 h6 form li button nobr image textarea optgroup option table select dd dt".split()) | _HEAD_TAGS
_SPECIAL_END = frozenset("template body html form p li dd dt br".split()) | C.HEADINGS | C.FORMATTING | _SCOPED_END
_EARLY_ENDS = frozenset(("head", "body", "html", "br"))


class Builder:
    """Builds one tree. A mode is the name of the method that takes the next token."""

    def __init__(self, html: str, options: ParseOptions = ParseOptions(), errors: list[ParseError] | None = None):
        self.options = options
        self.tree = Tree()
        self.tree.add(DOCUMENT, -1)
        self.errors = errors
        self.late: list[ParseError] | None = None if errors is None else []
        self.tokens = Tokenizer(html, options, self.late)
        self.mode = self.initial
        self.back = None
        self.open: list[int] = []
        self.names: list[str] = []  # of the open elements
        self.opened: dict[str, int] = {}  # how many are open, by name
        self.growing: int | None = None  # a text node whose pieces are not joined yet
        self.pieces: list[str] = []
        self.head: int | None = None
        self.form: int | None = None

    def build(self) -> Tree:
        raw = self.options.raw_text
        for token in self.tokens:
            self.mode(token)
            if raw and token.kind == START and (token.name in RCDATA or token.name in RAWTEXT or token.name == "plaintext") and self.names and self.names[-1] == token.name:
                self.tokens.switch = token.name
        self.join_text()
        if self.options.html_at_eof:
            names = {self.tree.name[i] for i in self.tree.walk()}
            for name in ("html", "head", "body"):
                if name not in names:
                    self.cut(name != "html")  # head and body stand in the first open element, html
                    self.implied(name)
        if self.errors is not None:
            self.errors += self.late
        return self.tree

    # small steps

    def error(self, code: str) -> None:
        if self.errors is not None:
            self.errors.append(ParseError.of(code))

    def current(self) -> int:
        return self.open[-1] if self.open else 0

    def push(self, i: int) -> None:
        name = self.tree.name[i]
        self.open.append(i)
        self.names.append(name)
        self.opened[name] = self.opened.get(name, 0) + 1

    def pop(self) -> None:
        if self.open:
            self.open.pop()
            self.opened[self.names.pop()] -= 1

    def drop(self, k: int) -> None:
        """Takes one element out of the open ones; those above it stay open."""
        self.opened[self.names[k]] -= 1
        del self.open[k], self.names[k]

    def cut(self, size: int) -> None:
        for name in self.names[size:]:
            self.opened[name] -= 1
        del self.open[size:], self.names[size:]

    def element(self, token: Token, name: str | None = None) -> int:
        name = name or token.name
        i = self.tree.add(ELEMENT, self.current(), name, token.attrs)
        if self.options.foreign_elements:
            up = self.tree.namespace.get(self.current())
            space = {"svg": "svg", "math": "mathml"}.get(name) or (up if up and self.names[-1] not in ("foreignobject", "desc", "title", "annotation-xml") else None)
            if space and name not in C.FOREIGN_BREAKOUT:
                self.tree.namespace[i] = space
                if token.self_closing:
                    return i
        if not (self.options.void_elements and name in C.VOID):
            self.push(i)
        return i

    def implied(self, name: str) -> None:
        i = self.tree.add(ELEMENT, self.current(), name)
        self.push(i)
        if name == "head":
            self.head = i

    def text(self, data: str) -> None:
        t, up = self.tree, self.current()
        if t.children[up] and t.kind[last := t.children[up][-1]] == TEXT:
            if last != self.growing:
                self.join_text()
                self.growing, self.pieces = last, [t.data[last]]
            self.pieces.append(data)
        else:
            t.add(TEXT, up, data=data)

    def join_text(self) -> None:
        if self.growing is not None:
            self.tree.data[self.growing] = "".join(self.pieces)
            self.growing = None

    def comment(self, token: Token, parent: int | None = None) -> None:
        self.tree.add(COMMENT_NODE, self.current() if parent is None else parent, data=token.data)

    def within(self, names: frozenset[str] | tuple, stop: frozenset[str]) -> bool:
        """Whether an element of these names is open in the scope that `stop` bounds."""
        if not any(map(self.opened.get, names)):
            return False
        for n in reversed(self.names):
            if n in names:
                return True
            if n in stop:
                return False
        return False

    def end_implied(self, but: str | None = None) -> None:
        while self.names and self.names[-1] != but and self.names[-1] in C.IMPLIED_END:
            self.pop()

    def close(self, *names: str) -> None:
        """Pops up to and with the nearest element of these names, or all."""
        k = len(self.names) - 1
        while k >= 0 and self.names[k] not in names:
            k -= 1
        self.cut(max(k, 0))

    def close_p(self) -> None:
        if self.within(("p",), C.BUTTON_SCOPE):
            self.end_implied("p")
            self.close("p")

    def as_text(self) -> None:
        self.back, self.mode = self.mode, self.in_text

    # before the body

    @staticmethod
    def blank(token: Token) -> bool:
        return token.kind == CHARS and not token.data.strip(C.ASCII_WS)

    def initial(self, token: Token) -> None:
        if token.kind == COMMENT:
            self.comment(token, 0)
        elif token.kind == DOCTYPE:
            i = self.tree.add(DOCTYPE_NODE, 0)
            self.tree.doctype[i] = (token.name, token.public_id, token.system_id, token.force_quirks)
            self.mode = self.before_html
        elif not self.blank(token):
            self.mode = self.before_html
            self.mode(token)

    def before_html(self, token: Token) -> None:
        if token.kind == DOCTYPE:
            self.error("unexpected-doctype")
        elif token.kind == COMMENT:
            self.comment(token, 0)
        elif self.blank(token):
            pass
        elif token.kind == START and token.name == "html":
            self.push(self.tree.add(ELEMENT, 0, "html", token.attrs))
            self.mode = self.before_head
        elif token.kind == END and token.name not in _EARLY_ENDS:
            self.error("unexpected-end-tag")
        else:
            self.push(self.tree.add(ELEMENT, 0, "html"))
            self.mode = self.before_head
            self.mode(token)

    def before_head(self, token: Token) -> None:
        if self.blank(token):
            pass
        elif token.kind == COMMENT:
            self.comment(token)
        elif token.kind == DOCTYPE:
            self.error("unexpected-doctype")
        elif token.kind == START and token.name == "html":
            self.in_body(token)
        elif token.kind == START and token.name == "head":
            self.head = self.element(token)
            self.mode = self.in_head
        elif token.kind == END and token.name not in _EARLY_ENDS:
            self.error("unexpected-end-tag")
        else:
            self.implied("head")
            self.mode = self.in_head
            self.mode(token)

    def leave_head(self, token: Token) -> None:
        self.pop()
        self.mode = self.after_head
        self.mode(token)

    def in_head(self, token: Token) -> None:
        kind, name = token.kind, token.name
        if self.blank(token):
            self.text(token.data)
        elif kind == COMMENT:
            self.comment(token)
        elif kind == DOCTYPE:
            self.error("unexpected-doctype")
        elif kind == START and name == "html":
            self.in_body(token)
        elif kind == START and name == "head":
            self.error("unexpected-start-tag")
        elif kind == START and name in _HEAD_TAGS:
            self.head_tag(token)
        elif kind == START and name == "noscript":
            self.element(token)
            self.mode = self.in_body
        elif kind == END and name == "head":
            self.pop()
            self.mode = self.after_head
        elif kind == END and name == "template":
            self.end_template()
        elif kind == END and name not in _EARLY_ENDS:
            self.error("unexpected-end-tag")
        else:
            self.leave_head(token)

    def head_tag(self, token: Token) -> None:
        """Tags of the head, wherever they are."""
        self.element(token)
        if token.name in _HEAD_VOID:
            if self.names[-1:] == [token.name]:
                self.pop()
        elif token.name in _HEAD_TEXT:
            self.as_text()
        else:
            self.mode = self.in_body

    def end_template(self) -> None:
        self.close("template")
        self.mode = self.in_body

    def after_head(self, token: Token) -> None:
        kind, name = token.kind, token.name
        if self.blank(token):
            self.text(token.data)
        elif kind == COMMENT:
            self.comment(token)
        elif kind == DOCTYPE:
            self.error("unexpected-doctype")
        elif kind == START and name == "html":
            self.in_body(token)
        elif kind == START and name in ("body", "frameset"):
            self.element(token)
            self.mode = self.in_body
        elif kind == START and name in _HEAD_TAGS:
            self.error("unexpected-start-tag")
            if self.head is not None:
                self.push(self.head)
                self.head_tag(token)
                if self.head in self.open:
                    self.drop(self.open.index(self.head))
        elif kind == START and name == "head":
            self.error("unexpected-start-tag")
        elif kind == END and name == "template":
            self.end_template()
        elif kind == END and name not in ("body", "html", "br"):
            self.error("unexpected-end-tag")
        else:
            self.implied("body")
            self.mode = self.in_body
            self.mode(token)

    # in the body and behind it

    def in_text(self, token: Token) -> None:
        if token.kind == CHARS:
            self.text(token.data)
        elif token.kind == END:
            self.pop()
            if self.back is not None:
                self.mode, self.back = self.back, None

    def after_body(self, token: Token) -> None:
        if self.blank(token) or token.kind == START and token.name == "html":
            self.in_body(token)
        elif token.kind == COMMENT:
            if self.open:
                self.comment(token, self.open[0])
        elif token.kind == DOCTYPE:
            self.error("unexpected-doctype")
        elif token.kind == END and token.name == "html":
            self.mode = self.after_after_body
        else:
            self.again(token)

    def after_after_body(self, token: Token) -> None:
        if token.kind == COMMENT:
            self.comment(token, 0)
        elif token.kind == DOCTYPE or self.blank(token) or token.kind == START and token.name == "html":
            self.in_body(token)
        else:
            self.again(token)

    def again(self, token: Token) -> None:
        self.error("unexpected-token-after-body")
        self.mode = self.in_body
        self.mode(token)

    def in_body(self, token: Token) -> None:
        kind = token.kind
        if kind == CHARS:
            self.text(token.data)
        elif kind == START:
            self.body_start(token, token.name)
        elif kind == END:
            self.body_end(token, token.name)
        elif kind == COMMENT:
            self.comment(token)
        else:
            self.error("unexpected-doctype")

    def body_start(self, token: Token, name: str) -> None:
        how = _BODY_START.get(name, 0)
        if name in _SPECIAL_START:
            if name in _HEAD_TAGS:
                self.head_tag(token)
                return
            if name in ("html", "body", "frameset"):
                self.error("unexpected-start-tag")
                if name == "html" and self.open:
                    t, root = self.tree, self.open[0]
                    t.attrs[root] = [*t.attrs[root], *((k, v) for k, v in token.attrs if not t.has(root, k))]
                return
            if name == "image":
                self.error("unexpected-start-tag")
                name, how = "img", _V
            elif name == "form":
                if self.form is not None and not self.opened.get("template"):
                    self.error("unexpected-start-tag")
                    return
            elif name == "li" or self.options.close_definition and name in ("dd", "dt"):
                self.close_item(("li",) if name == "li" else ("dd", "dt"))
            elif name == "button" and self.within(("button",), C.SCOPE):
                self.error("unexpected-start-tag")
                self.end_implied()
                self.close("button")
            elif name == "nobr" and self.within(("nobr",), C.SCOPE):
                self.error("unexpected-start-tag")
                self.close("nobr")
            elif name in ("optgroup", "option") and self.names[-1:] == ["option"]:
                self.pop()
        if how & _P:
            self.close_p()
        if name in C.HEADINGS and self.names and self.names[-1] in C.HEADINGS:
            self.error("unexpected-start-tag")
            self.pop()
        size = len(self.open)
        i = self.element(token, name)
        if how & _V:
            self.cut(size)
        if name == "form" and not self.opened.get("template"):
            self.form = i
        elif name == "textarea":
            self.as_text()

    def close_item(self, names: tuple[str, ...]) -> None:
        """An open list item ends where the next one begins."""
        if not any(map(self.opened.get, names)):
            return
        for n in reversed(self.names):
            if n in names:
                self.end_implied(n)
                self.close(n)
                return
            if n in C.SPECIAL and n not in ("address", "div", "p"):
                return

    def body_end(self, token: Token, name: str) -> None:
        if name not in _SPECIAL_END:
            self.other_end(name)
        elif name in C.FORMATTING:
            for k in range(len(self.names) - 1, -1, -1) if self.opened.get(name) else ():
                if self.names[k] == name:
                    self.drop(k)
                    break
        elif name == "template":
            self.end_template()
        elif name in ("body", "html"):
            if not self.within(("body",), C.SCOPE):
                self.error("unexpected-end-tag")
            else:
                self.mode = self.after_body
                if name == "html":
                    self.mode(token)
        elif name == "p":
            if not self.within(("p",), C.BUTTON_SCOPE):
                self.error("unexpected-end-tag")
                self.implied("p")
            self.end_implied("p")
            self.close("p")
        elif name == "br":
            self.error("unexpected-end-tag")
            self.tree.add(ELEMENT, self.current(), "br")
        elif name == "form":
            self.end_form()
        else:
            names = tuple(C.HEADINGS) if name in C.HEADINGS else (name,)
            if not self.within(names, C.LIST_SCOPE if name == "li" else C.SCOPE):
                self.error("unexpected-end-tag")
                return
            self.end_implied(name if name in ("li", "dd", "dt") else None)
            self.close(*names)

    def end_form(self) -> None:
        inside = bool(self.opened.get("template"))
        form = None if inside else self.form
        if not inside:
            self.form = None
        if not inside and form is None or not self.within(("form",), C.SCOPE):
            self.error("unexpected-end-tag")
            return
        self.end_implied()
        if inside:
            self.close("form")
        elif form in self.open:
            self.drop(self.open.index(form))

    def other_end(self, name: str) -> None:
        for k in range(len(self.names) - 1, -1, -1):
            if self.names[k] == name:
                self.cut(k)
                return
            if self.names[k] in C.SPECIAL:
                self.error("unexpected-end-tag")
                return


def parse(html: str | None, options: ParseOptions = ParseOptions(), errors: list[ParseError] | None = None) -> Tree:
    # a tree holds no cycles, and looking for some while it grows takes a third of the time
    paused = gc.isenabled()
    gc.disable()
    try:
        builder = Builder(html or "", options, errors)
        tree = builder.build()
        builder.mode = builder.back = None
        return tree
    finally:
        if paused:
            gc.enable()


@dataclass
class Places:
    """Where the nodes of a tree stand, by node."""

    order: list[int]
    pre: list[int]
    last: list[int]
    depth: list[int]
    sib: list[int]
    elem: list[int | None]
    elem_rev: list[int | None]
    same: list[int | None]
    same_rev: list[int | None]
    prev: list[int | None]


def places(t: Tree) -> Places:
    """pre and last: a is an ancestor of d if pre[a] < pre[d] <= last[a]; the others count siblings from 1."""
    n = len(t.kind)
    order = t.walk()
    pre, last, depth, sib = [0] * n, [0] * n, [0] * n, [1] * n
    elem, elem_rev, same, same_rev, prev = ([None] * n for _ in range(5))
    for p, i in enumerate(order):
        pre[i] = p + 1
        if t.parent[i] >= 0:
            depth[i] = depth[t.parent[i]] + 1
        seen: dict[str, int] = {}
        elems = [c for c in t.children[i] if t.kind[c] == ELEMENT]
        for k, c in enumerate(t.children[i]):
            sib[c] = k + 1
        for k, c in enumerate(elems):
            elem[c], elem_rev[c], prev[c] = k + 1, len(elems) - k, elems[k - 1] + 1 if k else None
            same[c] = seen[t.name[c]] = seen.get(t.name[c], 0) + 1
        for c in elems:
            same_rev[c] = seen[t.name[c]] - same[c] + 1
    for i in reversed(order):
        last[i] = max(pre[i], last[t.children[i][-1]] if t.children[i] else 0)
    return Places(order, pre, last, depth, sib, elem, elem_rev, same, same_rev, prev)
