"""HTML text to tokens, by regular expressions over whole constructs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from ..constants import ENTITIES, HTML_WS, LEGACY_ENTITIES, NUMERIC_REPLACEMENTS
from ..options import ParseOptions
from .errors import ParseError, Positions

START, END, CHARS, COMMENT, DOCTYPE = "start", "end", "chars", "comment", "doctype"
Attrs = list[tuple[str, str | None]]


class Token(NamedTuple):
    kind: str
    name: str | None = None
    attrs: Attrs | tuple = ()
    self_closing: bool = False
    data: str | None = None
    public_id: str | None = None
    system_id: str | None = None
    force_quirks: bool = False


_ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_SIMPLE_TAG = re.compile(r'([a-z][a-z0-9]*)((?: [a-z-]+="[^"\0]*")+)>')
_SIMPLE_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')
_TAG_NAME = re.compile(rf"[^{HTML_WS}/>]+")
_PLAIN_TAG = re.compile(r"[a-z][a-z0-9]*>")
_ATTRIBUTE = re.compile(
    rf"""[{HTML_WS}]*(?:(?P<slash>/)|(?P<end>>)|(?P<name>=?[^{HTML_WS}/>=]*)[{HTML_WS}]*"""
    rf"""(?P<eq>=[{HTML_WS}]*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<none>(?=>))|(?P<bare>(?!["'])[^{HTML_WS}>]+))?)?)"""
)
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*)(;?))")
RCDATA, RAWTEXT = frozenset(("title", "textarea")), frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))


def lower(s: str) -> str:
    """ASCII letters only."""
    return s.lower() if s.isascii() else s.translate(_ASCII_LOWER)


def decode_numeric(n: int) -> str:
    if n in NUMERIC_REPLACEMENTS:
        return NUMERIC_REPLACEMENTS[n]
    return "\ufffd" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def decode_entities(text: str, in_attribute: bool = False) -> str:
    def one(m: re.Match) -> str:
        hexa, dec, name, semi = m.groups()
        if hexa or dec:
            digits = (hexa or dec).lstrip("0") or "0"
            return decode_numeric(int(digits, 16 if hexa else 10)) if len(digits) < 12 else "\ufffd"
        if semi and name in ENTITIES:
            return ENTITIES[name]
        for k in range(len(name), 1, -1):
            if name[:k] in LEGACY_ENTITIES and name[:k] in ENTITIES:
                after = name[k : k + 1] or semi or m.string[m.end() : m.end() + 1]
                if in_attribute and (after.isalnum() or after == "="):
                    return m.group()
                return ENTITIES[name[:k]] + name[k:] + semi
        return m.group()

    return _REFERENCE.sub(one, text) if "&" in text else text


class Tokenizer:
    """Iterates over the tokens of one text. `switch` is what the tree builder asks for after a start tag."""

    def __init__(self, html: str, options: ParseOptions = ParseOptions(), errors: list[ParseError] | None = None):
        self.options, self.errors = options, errors
        if html[:1] == "\ufeff":
            html, self.shift = html[1:], 1
        else:
            self.shift = 0
        self.html = html
        self.lines = Positions(html) if errors is not None else None
        self.switch: str | None = None
        self.plain: dict[tuple[str, str], Token] = {}  # tags without attributes, each made once

    def error(self, code: str, end: int) -> None:
        """end: behind the character at which the error shows."""
        if self.errors is not None:
            line, col = self.lines.at(end)
            self.errors.append(ParseError.of(code, (line, col + self.shift if line == 1 else col)))

    def _nulls(self, start: int, end: int) -> str:
        s = self.html[start:end]
        if "\0" in s:
            if self.errors is not None:
                for m in re.finditer("\0", s):
                    self.error("unexpected-null-character", start + m.start() + 1)
            s = s.replace("\0", "\ufffd")
        return s

    def _chars(self, start: int, end: int) -> Token:
        s = self._nulls(start, end)
        return Token(CHARS, data=decode_entities(s) if self.options.decode_entities else s)

    def __iter__(self) -> Iterator[Token]:
        html, n, i, find = self.html, len(self.html), 0, self.html.find
        while i < n:
            if self.switch:
                name, self.switch = self.switch, None
                if name == "plaintext":
                    yield Token(CHARS, data=self._nulls(i, n))
                    return
                m = re.compile(rf"</{re.escape(name)}(?=[{HTML_WS}/>])", re.I).search(html, i)
                end = m.start() if m else n
                if end > i:
                    s = self._nulls(i, end)
                    yield Token(CHARS, data=decode_entities(s) if self.options.decode_entities and name in RCDATA else s)
                i = end
                continue
            if html[i] != "<":
                j = find("<", i)
                j = n if j < 0 else j
                yield self._chars(i, j)
                i = j
                continue
            c = html[i + 1 : i + 2]
            if "a" <= c <= "z" or "A" <= c <= "Z":
                token, i = self._tag(i + 1, START)
            elif c == "/":
                d = html[i + 2 : i + 3]
                if "a" <= d <= "z" or "A" <= d <= "Z":
                    token, i = self._tag(i + 2, END)
                elif d == ">":
                    self.error("missing-end-tag-name", i + 3)
                    token, i = None, i + 3
                elif not d:
                    token, i = self._cut("</", n)
                else:
                    self.error("invalid-first-character-of-tag-name", i + 3)
                    token, i = self._bogus(i + 2, "")
            elif c == "!":
                token, i = self._declaration(i + 2)
            elif c == "?":
                self.error("unexpected-question-mark-instead-of-tag-name", i + 2)
                token, i = self._bogus(i + 1, "")
            elif not c:
                token, i = self._cut("<", n)
            else:
                self.error("invalid-first-character-of-tag-name", i + 2)
                j = find("<", i + 1)
                j = n if j < 0 else j
                token, i = self._chars(i, j), j
            if token is not None:
                yield token

    def _cut(self, rest: str, n: int) -> tuple[Token | None, int]:
        """The input ends in the middle of a tag's first characters."""
        if self.options.eof_flush:
            self.error("eof-before-tag-name", n)
            return Token(CHARS, data=rest), n
        return None, n

    def _tag(self, i: int, kind: str) -> tuple[Token | None, int]:
        html, n = self.html, len(self.html)
        m = _PLAIN_TAG.match(html, i)
        if m:
            end = m.end()
            key = (kind, html[i : end - 1])
            token = self.plain.get(key)
            if token is None:
                token = self.plain[key] = Token(*key)
            return token, end
        m = _SIMPLE_TAG.match(html, i)
        if m and not self.options.decode_entities and not self.options.empty_values:
            found = _SIMPLE_ATTR.findall(m[2])
            if len(found) == 1 or len({k for k, _ in found}) == len(found):
                return Token(kind, m[1], [(k, v or None) for k, v in found]), m.end()
        m = _TAG_NAME.match(html, i)
        name, i = lower(self._nulls(i, m.end())), m.end()
        attrs: Attrs = []
        seen: set[str] = set()
        quoted = False
        while i < n:
            m = _ATTRIBUTE.match(html, i)
            if quoted and self.errors is not None and html[i] not in HTML_WS and not m["slash"] and not m["end"]:
                self.error("missing-whitespace-between-attributes", i + 1)
            quoted = False
            if m["end"]:
                return Token(kind, name, attrs, False), m.end()
            if m["slash"]:
                i = m.end()
                if html[i : i + 1] == ">":
                    return Token(kind, name, attrs, True), i + 1
                if i < n:
                    self.error("unexpected-solidus-in-tag", i + 1)
                continue
            if not m["name"] and not m["eq"]:  # only white space is left
                break
            if m["eq"] and m["dq"] is m["sq"] is m["none"] is m["bare"] is None:  # a value that the input cuts off
                i = n
                break
            a, e = m.span("name")
            if self.errors is not None:
                if html[a] == "=":
                    self.error("unexpected-equals-sign-before-attribute-name", a + 1)
                for x in re.finditer("[\"'<]", html[a:e]):
                    self.error("unexpected-character-in-attribute-name", a + x.start() + 1)
            key = lower(self._nulls(a, e))
            value, group = None, next((g for g in ("dq", "sq", "bare") if m[g] is not None), None)
            if group:
                quoted = group != "bare"
                va, ve = m.span(group)
                value = self._nulls(va, ve)
                if self.errors is not None and not quoted:
                    for x in re.finditer("[\"'<=`]", html[va:ve]):
                        self.error("unexpected-character-in-unquoted-attribute-value", va + x.start() + 1)
                if self.options.decode_entities:
                    value = decode_entities(value, True)
            if m["none"] is not None:
                self.error("missing-attribute-value", m.end() + 1)
            i = m.end()
            if i >= n and not quoted:  # the end of the name or of the value has not been seen
                break
            if key in seen:
                self.error("duplicate-attribute", min(i + (not quoted), n))
            else:
                seen.add(key)
                attrs.append((key, value or ("" if self.options.empty_values else None)))
        if self.options.eof_flush:
            self.error("eof-in-tag", n)
        return None, n

    def _comment(self, data: str, end: int) -> tuple[Token, int]:
        return Token(COMMENT, data=data), end

    def _bogus(self, i: int, head: str) -> tuple[Token | None, int]:
        end = self.html.find(">", i)
        if end < 0:
            n = len(self.html)
            return (Token(COMMENT, data=head + self._nulls(i, n)), n) if self.options.eof_flush else (self._nulls(i, n) and None, n)
        return self._comment(head + self._nulls(i, end), end + 1)

    def _declaration(self, i: int) -> tuple[Token | None, int]:
        """Behind `<!`."""
        html, n = self.html, len(self.html)
        if html.startswith("--", i):
            i += 2
            for short in (">", "->"):
                if html.startswith(short, i):
                    self.error("abrupt-closing-of-empty-comment", i + len(short))
                    return self._comment("", i + len(short))
            m = _COMMENT_END.search(html, i)
            if not m:
                data = self._nulls(i, n)
                if self.options.eof_flush:
                    self.error("eof-in-comment", n)
                    return Token(COMMENT, data=re.sub("--!?$|-$", "", data)), n
                return None, n
            data = self._nulls(i, m.start())
            if m.group() == "--!>":
                self.error("incorrectly-closed-comment", m.end())
            return self._comment(data, m.end())
        if lower(html[i : i + 7]) == "doctype":
            return self._doctype(i + 7)
        if html.startswith("[CDATA[", i):
            self.error("cdata-in-html-content", i + 7)
            return self._bogus(i + 7, "")
        if i >= n:
            return (Token(COMMENT, data=""), n) if self.options.eof_flush else (None, n)
        self.error("incorrectly-opened-comment", i + 1)
        return self._bogus(i + 1, html[i])

    def _doctype(self, i: int) -> tuple[Token | None, int]:
        html, n = self.html, len(self.html)
        if i < n and html[i] not in HTML_WS + ">":
            self.error("missing-whitespace-before-doctype-name", i + 1)
        while i < n and html[i] in HTML_WS:
            i += 1
        if i < n and html[i] == ">":
            self.error("missing-doctype-name", i + 1)
            return Token(DOCTYPE, force_quirks=True), i + 1
        m = re.compile(rf".[^{HTML_WS}>]*", re.S).match(html, i)
        if not m:
            return self._cut_doctype(None, None, None)
        name, i = lower(self._nulls(i, m.end())), m.end()
        while i < n and html[i] in HTML_WS:
            i += 1
        if i >= n:
            return self._cut_doctype(name, None, None)
        if html[i] == ">":
            return Token(DOCTYPE, name), i + 1
        # the keyword is looked for behind the character that should begin it, unless the option mends this
        at = i if self.options.doctype_ids else i + 1
        for word in ("public", "system"):
            if lower(html[at : at + 6]) == word:
                return self._identifiers(at + 6, name, word)
        self.error("invalid-character-sequence-after-doctype-name", i + 1)
        return self._bogus_doctype(i, name, None, None, True)

    def _cut_doctype(self, name: str | None, public: str | None, system: str | None) -> tuple[Token | None, int]:
        n = len(self.html)
        if self.options.eof_flush:
            self.error("eof-in-doctype", n)
            return Token(DOCTYPE, name, public_id=public, system_id=system, force_quirks=True), n
        return None, n

    def _bogus_doctype(self, i: int, name: str, public: str | None, system: str | None, quirks: bool) -> tuple[Token | None, int]:
        end = self.html.find(">", i)
        if end < 0:
            self._nulls(i, len(self.html))
            return self._cut_doctype(name, public, system)
        self._nulls(i, end)
        return Token(DOCTYPE, name, public_id=public, system_id=system, force_quirks=quirks), end + 1

    def _identifiers(self, i: int, name: str, word: str) -> tuple[Token | None, int]:
        """Behind the keyword: a public and a system identifier, or the latter only."""
        html, n = self.html, len(self.html)
        ids: dict[str, str] = {}
        todo = ["public", "system"] if word == "public" else ["system"]
        for k, what in enumerate(todo):
            blank = i < n and html[i] in HTML_WS
            while i < n and html[i] in HTML_WS:
                i += 1
            if i >= n:
                return self._cut_doctype(name, ids.get("public"), ids.get("system"))
            c = html[i]
            if c == ">":
                if k == 0:
                    self.error(f"missing-doctype-{what}-identifier", i + 1)
                return Token(DOCTYPE, name, public_id=ids.get("public"), force_quirks=k == 0), i + 1
            if c not in "\"'":
                self.error(f"missing-quote-before-doctype-{what}-identifier", i + 1)
                return self._bogus_doctype(i, name, ids.get("public"), None, True)
            if not blank:
                self.error("missing-whitespace-between-doctype-public-and-system-identifiers" if k else f"missing-whitespace-after-doctype-{what}-keyword", i + 1)
            m = re.compile(f"[^{c}>]*").match(html, i + 1)
            ids[what] = self._nulls(i + 1, m.end())
            i = m.end()
            if i >= n:
                return self._cut_doctype(name, ids.get("public"), ids.get("system"))
            if html[i] == ">":
                self.error(f"abrupt-doctype-{what}-identifier", i + 1)
                return Token(DOCTYPE, name, public_id=ids.get("public"), system_id=ids.get("system"), force_quirks=True), i + 1
            i += 1
        while i < n and html[i] in HTML_WS:
            i += 1
        if i < n and html[i] != ">":
            self.error("unexpected-character-after-doctype-system-identifier", i + 1)
        return self._bogus_doctype(i, name, ids.get("public"), ids.get("system"), False)


def tokenize(html: str | None, options: ParseOptions = ParseOptions(), errors: list[ParseError] | None = None) -> Iterator[Token]:
    """Tokens of a text. With raw_text, contents of script, style and the like are one token."""
    t = Tokenizer(html or "", options, errors)
    for token in t:
        if options.raw_text and token.kind == START and (token.name in RCDATA or token.name in RAWTEXT or token.name == "plaintext"):
            t.switch = token.name
        yield token
