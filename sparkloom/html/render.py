"""Trees to HTML, Markdown and text. All walks keep their own stack, so depth is no limit."""

from __future__ import annotations

import re
from collections.abc import Callable

from .. import constants as C
from ..options import HtmlOptions, MarkdownOptions, ParseOptions
from .tree import COMMENT_NODE, DOCTYPE_NODE, ELEMENT, TEXT, Tree

_BLANKS = re.compile(f"[{C.UNICODE_WS}]+")
_SILENT = frozenset(("script", "style"))


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;")


def doctype_text(name: str | None, public: str | None, system: str | None) -> str:
    out = f"<!DOCTYPE {'html' if name is None else name}"
    if public:
        out += f' PUBLIC "{public}"'
    if system:
        out += f' SYSTEM "{system}"' if public is None else f' "{system}"'
    return out + ">"


def open_tag(name: str, attrs: list[tuple[str, str | None]]) -> str:
    return "<" + name + "".join(f" {k}" if v is None else f' {k}="{escape_attribute(v)}"' for k, v in attrs) + ">"


def to_html(t: Tree, root: int = 0, options: HtmlOptions = HtmlOptions(), raw_names: frozenset[str] = C.RAW_TEXT_OUTPUT) -> str:
    """raw_names: elements whose text is written as it is."""
    out: list[str] = []
    put, pretty, pad = out.append, options.pretty, options.indent
    begun = False  # something has been written
    todo: list[tuple[int, int] | str] = [(root, 0)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            put(item)
            continue
        i, depth = item
        kind = t.kind[i]
        if kind == TEXT:
            up = t.parent[i]
            raw = up >= 0 and t.kind[up] == ELEMENT and t.name[up] in raw_names
            put(t.data[i] if raw else escape_text(t.data[i]))
            begun = begun or bool(t.data[i])
        elif kind == ELEMENT:
            name, kids = t.name[i], t.children[i]
            if pretty and begun:
                put(pad * depth)
            begun = True
            put(open_tag(name, t.attrs[i]))
            if name in C.VOID:
                if pretty:
                    put("\n")
                continue
            spread = pretty and kids and name not in raw_names
            if spread:
                put("\n")
            todo.append(f"{pad * depth if spread else ''}</{name}>" + ("\n" if pretty else ""))
            todo.extend((c, depth + 1) for c in reversed(kids))
        elif kind == COMMENT_NODE:
            put(f"{pad * depth if pretty else ''}<!--{t.data[i]}-->" + ("\n" if pretty else ""))
            begun = True
        elif kind == DOCTYPE_NODE:
            if options.include_doctype:
                begun = True
                put(doctype_text(*t.doctype.get(i, (None, None, None, False))[:3]) + ("\n" if pretty else ""))
        else:
            todo.extend((c, depth) for c in reversed(t.children[i]))
    return "".join(out)


def to_text(t: Tree, root: int = 0, mode: str = "plain") -> str:
    """mode `block` puts block elements on lines of their own."""
    out: list[str] = []
    todo: list[int | None] = [root]
    end = ""  # the last character so far

    def line() -> None:
        nonlocal end
        if end and end != "\n":
            out.append("\n")
            end = "\n"

    while todo:
        i = todo.pop()
        if i is None:
            line()
        elif t.kind[i] == TEXT:
            out.append(t.data[i])
            end = t.data[i][-1:] or end
        elif t.kind[i] == ELEMENT and t.name[i] in _SILENT:
            continue
        else:
            if mode == "block" and t.kind[i] == ELEMENT and t.name[i] in C.BLOCK_TEXT:
                line()
                todo.append(None)
            todo.extend(reversed(t.children[i]))
    return "".join(out)


def _all_text(t: Tree, root: int) -> str:
    return "".join(t.data[i] for i in t.walk(root) if t.kind[i] == TEXT)


class _Markdown:
    """What is written around the children of an element is looked up by its name."""

    def __init__(self, t: Tree, options: MarkdownOptions, parse: ParseOptions):
        self.t, self.o, self.spaces = t, options, parse.markdown_spaces
        self.out: list[str] = []
        self.tail = ""  # the last two characters
        self.lists = 0
        self.numbers: list[int] = []
        self.pre = False
        self.kinds: list[bool] = []  # of the open lists: ordered

    def put(self, s: str) -> None:
        if s:
            self.out.append(s)
            self.tail = (self.tail + s)[-2:]

    def line(self) -> None:
        if self.tail and self.tail[-1] != "\n":
            self.put("\n")

    def blank(self) -> None:
        if self.tail and self.tail != "\n\n":
            self.put("\n" if self.tail[-1] == "\n" else "\n\n")

    def text(self, s: str) -> None:
        if self.pre:
            self.put(s)
        elif self.spaces:  # white space at the start of a text counts unless the output has some already
            s = _BLANKS.sub(" ", s)
            self.put(s.lstrip(" ") if not self.tail or self.tail[-1] in " \n" else s)
        else:
            self.put(_BLANKS.sub(" ", s.lstrip(C.UNICODE_WS)))

    def begin(self, i: int) -> Callable[[], None] | None | bool:
        """Writes what comes before the children; returns what writes the rest, or False if children are done."""
        t, o, name = self.t, self.o, self.t.name[i]
        around = {"b": o.strong_char, "strong": o.strong_char, "i": o.emphasis_char, "em": o.emphasis_char, "u": o.emphasis_char, "s": "~~", "strike": "~~", "del": "~~"}
        if not self.pre:
            around["code"] = "`"
        if name in around:
            self.put(around[name])
            return lambda: self.put(around[name])
        if name in C.HEADINGS:
            self.blank()
            if o.atx_headers:
                self.put("#" * int(name[1]) + " ")
                return self.blank
            return lambda: (self.put("\n" + ("=" if name == "h1" else "-") * 20), self.blank())
        if name in ("p", "table"):
            self.blank()
            return self.blank
        if name in ("div", "section", "article", "main", "aside", "header", "footer", "nav"):
            self.line()
            return self.line
        if name == "a":
            self.put("[")
            return lambda: self.put(f"]({t.attr(i, 'href') or ''})")
        if name == "img":
            self.put(f"![{t.attr(i, 'alt') or ''}]({t.attr(i, 'src') or ''})")
            return False
        if name in ("ul", "ol"):
            self.line()
            self.lists += 1
            if name == "ol":
                self.numbers.append(1)
            self.kinds.append(name == "ol")

            def end_list() -> None:
                if name == "ol":
                    self.numbers.pop()
                self.kinds.pop()
                self.lists -= 1
                self.line()

            return end_list
        if name == "li":
            self.line()
            self.put("  " * (self.lists - 1))
            if self.numbers and (not self.spaces or self.kinds[-1]):
                self.put(f"{self.numbers[-1]}. ")
                self.numbers[-1] += 1
            else:
                self.put(f"{o.bullet_char} ")
            return None
        if name == "blockquote":
            self.blank()
            lines = _all_text(t, i).split("\n")
            for s in lines[:-1] if lines[-1] == "" else lines:
                self.put(f"> {s[:-1] if s.endswith(chr(13)) else s}\n")
            self.line()
            return False
        if name == "pre":
            self.blank()
            self.put(f"{o.code_fence}\n")
            self.pre = True

            def end_pre() -> None:
                self.pre = False
                self.line()
                self.put(o.code_fence)
                self.blank()

            return end_pre
        if name == "hr":
            self.blank()
            self.put("---")
            self.blank()
            return False
        if name == "br":
            self.put("  \n")
            return False
        if name == "tr":
            self.put("|")
            return lambda: self.put("\n")
        if name in ("th", "td"):
            self.put(" ")
            return lambda: self.put(" |")
        return None

    def run(self, root: int) -> str:
        t, todo = self.t, [root]
        while todo:
            item = todo.pop()
            if callable(item):
                item()
            elif t.kind[item] == TEXT:
                self.text(t.data[item])
            elif t.kind[item] in (DOCTYPE_NODE, COMMENT_NODE) or self.spaces and t.name[item] in _SILENT:
                continue
            else:
                rest = self.begin(item) if t.kind[item] == ELEMENT else None
                if rest is not False:
                    if rest is not None:
                        todo.append(rest)
                    todo.extend(reversed(t.children[item]))
        s = "".join(self.out).strip(C.UNICODE_WS)
        return s and s + "\n"


def to_markdown(t: Tree, root: int = 0, options: MarkdownOptions = MarkdownOptions(), parse: ParseOptions = ParseOptions()) -> str:
    return _Markdown(t, options, parse).run(root)


def dump(t: Tree, root: int = 0) -> str:
    """One line a node, indented by depth."""
    out, todo = [], [(root, 0)]
    while todo:
        i, d = todo.pop()
        out.append("  " * d + t.name[i] + "".join(f" {k}={v!r}" for k, v in t.attrs[i]) + (f" {t.data[i]!r}" if t.data[i] is not None else ""))
        todo.extend((c, d + 1) for c in reversed(t.children[i]))
    return "\n".join(out)
