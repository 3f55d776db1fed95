import pytest

from sparkloom.html.cursor import Cursor
from sparkloom.html.errors import ParseError, Positions
from sparkloom.html.tokenizer import Token, decode_entities, decode_numeric, tokenize
from sparkloom.options import ParseOptions

S, E, C, M = (lambda name, *attrs, sc=False: ("start", name, list(attrs), sc)), (lambda name: ("end", name)), (lambda s: ("chars", s)), (lambda s: ("comment", s))


def short(t: Token):
    return {"start": lambda: ("start", t.name, list(t.attrs), t.self_closing), "end": lambda: ("end", t.name)}.get(t.kind, lambda: (t.kind, t.data) if t.kind != "doctype" else ("doctype", t.name, t.public_id, t.system_id, t.force_quirks))()


CASES = [
    ("", []),
    ("<p>Hello</p>", [S("p"), C("Hello"), E("p")]),
    ("<br/>", [S("br", sc=True)]),
    ("<br / >", [S("br")]),
    ("<!-- c -->", [M(" c ")]),
    ("<input type=\"checkbox\" checked>", [S("input", ("type", "checkbox"), ("checked", None))]),
    ("<DIV CLASS='Test'>", [S("div", ("class", "Test"))]),
    ("<div", []),
    ("<div a", []),
    ("<div a=", []),
    ("<div a='x", []),
    ("<div a='x'", []),
    ("a <", [C("a ")]),
    ("a < b", [C("a "), C("< b")]),
    ("<<b>", [C("<"), S("b")]),
    ("&lt;", [C("&lt;")]),
    ("<input type=\"\">", [S("input", ("type", None))]),
    ("<a x=1 x=2>", [S("a", ("x", "1"))]),
    ("<a x=1/>y", [S("a", ("x", "1/")), C("y")]),
    ("<a =x>", [S("a", ("=x", None))]),
    ("<a b = \"c\"d>", [S("a", ("b", "c"), ("d", None))]),
    ("<a b= >", [S("a", ("b", None))]),
    ("<a/b/>", [S("a", ("b", None), sc=True)]),
    ("<a\n b\t=\fc>", [S("a", ("b", "c"))]),
    ("<![CDATA[Some <text> & stuff]]>", [M("Some <text"), C(" & stuff]]>")]),
    ("<?xml v?>x", [M("?xml v?"), C("x")]),
    ("</>x", [C("x")]),
    ("</ x>y", [M(" x"), C("y")]),
    ("<!>x>y", [M(">x"), C("y")]),
    ("<!-->x", [M(""), C("x")]),
    ("<!--->x", [M(""), C("x")]),
    ("<!----->", [M("-")]),
    ("<!--a--!>b", [M("a"), C("b")]),
    ("<!--a", []),
    ("a\0b", [C("a�b")]),
    ("﻿x", [C("x")]),
    ("<!doctype html>", [("doctype", "html", None, None, False)]),
    ("<!DOCTYPE>", [("doctype", None, None, None, True)]),
    ("<!DOCTYPE HTML PUBLIC \"-//W3C//DTD HTML 4.01//EN\" \"u\">", [("doctype", "html", None, None, True)]),
    ("<!DOCTYPE html", []),
    ("<!dog>", [M("dog")]),
]


@pytest.mark.parametrize("html,want", CASES)
def test_tokens(html, want):
    assert [short(t) for t in tokenize(html)] == want


def test_spec_profile():
    spec = ParseOptions.spec()
    got = lambda h: [short(t) for t in tokenize(h, spec)]
    assert got("<script>a<b>c</script>d") == [S("script"), C("a<b>c"), E("script"), C("d")]
    assert got("<title>a&amp;<b></title>") == [S("title"), C("a&<b>"), E("title")]
    assert got("<!DOCTYPE html PUBLIC \"p\" 's'>") == [("doctype", "html", "p", "s", False)]
    assert got("<!DOCTYPE html SYSTEM 's'>") == [("doctype", "html", None, "s", False)]
    assert got("a <") == [C("a "), C("<")]
    assert got("<a href='?a=1&copy=2&amp;b' title=\"\">") == [S("a", ("href", "?a=1&copy=2&b"), ("title", ""))]


@pytest.mark.parametrize("html,want", [
    ("<a x=1 x=2>", ["(1,12): duplicate-attribute - Duplicate attribute name"]),
    ("<?x>", ["(1,3): unexpected-question-mark-instead-of-tag-name - Unexpected ? instead of tag name"]),
    ("\n</>", ["(2,4): missing-end-tag-name"]),
    ("<a 'b>", ["(1,5): unexpected-character-in-attribute-name - Unexpected character in attribute name"]),
    ("<a b=\"c\"d>", ["(1,10): missing-whitespace-between-attributes - Missing whitespace between attributes"]),
    ("<a b=c'd>", ["(1,8): unexpected-character-in-unquoted-attribute-value - Unexpected character in unquoted attribute value"]),
    ("<p>ok</p>", []),
])
def test_errors(html, want):
    found: list[ParseError] = []
    list(tokenize(html, errors=found))
    assert [str(e) for e in found] == want


def test_entities():
    assert decode_entities("&lt;&#60;&#x3c;&unknown;&AMP") == "<<<&unknown;&"
    assert [decode_numeric(n) for n in (60, 0x80, 0, 0xD800, 0x110000)] == ["<", "€", "�", "�", "�"]


def test_positions():
    p = Positions("ab\nc\n")
    assert [p.at(i) for i in range(6)] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1)]


def test_cursor():
    c = Cursor("aB\n<!DocType x")
    assert c.peek() == "a" and c.peek(2, 1) == "B\n" and c.take_while(str.isalpha) == "aB" and c.position == (1, 3)
    at = c.checkpoint()
    assert c.take() == "\n" and c.position == (2, 1) and not c.skip("<!doctype") and c.skip("<!doctype", True) and c.remaining == " x"
    c.restore(at)
    assert c.offset == 2 and c.take(99) == "\n<!DocType x" and c.is_empty and c.take() == "" and c.position_at(0) == (1, 1)


def test_error_display():
    assert str(ParseError.of("eof-in-tag", (5, 10))) == "(5,10): eof-in-tag - Unexpected end of file in tag"
    assert str(ParseError.of("unexpected-start-tag", (1, 1), tag="script")) == "(1,1): unexpected-start-tag - Unexpected <script> start tag"
    assert str(ParseError.of("duplicate-attribute")) == "duplicate-attribute - Duplicate attribute name"
    assert str(ParseError.of("no-such-code")) == "no-such-code"
