"""Trees, selectors, cleaning and output of single documents."""

import random

import pytest

from sparkloom import DEFAULT_POLICY, HtmlOptions, MarkdownOptions, ParseOptions, SanitizationPolicy, SelectorError, UnsafeHtmlError, UrlPolicy, UrlProxy, UrlRule
from sparkloom.html.clean import clean, extract_host
from sparkloom.html.match import Matcher, nth
from sparkloom.html.render import dump, to_html, to_markdown, to_text
from sparkloom.html.tree import ELEMENT, parse, places
from sparkloom.plans.selector import parse_nth, parse_selector

SPEC = ParseOptions.spec()


def page(body):
    return f"<html><head></head><body>{body}</body></html>"


HTML = [
    ("", ""),
    ("  \n", ""),
    ("<!-- c -->", "<!-- c -->"),
    ("<p>Hello</p>", page("<p>Hello</p>")),
    ("<p>a &amp; b", page("<p>a &amp;amp; b</p>")),
    ("<b><i>x</b>y</i>", page("<b><i>xy</i></b>")),
    ("<picture><source srcset=\"l\"><img src=\"s\"></picture>", page("<picture><source srcset=\"l\"></picture>")),
    ("<table><tr><td>A<td>B</table>", page("<table><tr><td>A<td>B</td></td></tr></table>")),
    ("<table><tr><td>A<td>B</table>C", page("<table><tr><td>A<td>BC</td></td></tr></table>")),
    ("<dl><dt>A<dd>B</dl>", page("<dl><dt>A<dd>B</dd></dt></dl>")),
    ("<ul><li>A<li>B</ul>", page("<ul><li>A</li><li>B</li></ul>")),
    ("<p>A<p>B", page("<p>A</p><p>B</p>")),
    ("<div></p></div>", page("<div><p></p></div>")),
    ("<script>var t=\"</p>\";f();</script><p>x", "<html><head><script>var t=\"</script></head><body>\";f();<p>x</p></body></html>"),
    ("<title>a <b>c</b> d</title>", "<html><head><title>a c</title></head><body> d</body></html>"),
    ("<div/>x", page("<div>x</div>")),
    ("<h1>a<h2>b", page("<h1>a</h1><h2>b</h2>")),
    ("<a>1<a>2", page("<a>1<a>2</a></a>")),
    ("<html lang=en><html lang=de dir=ltr>", "<html lang=\"en\" dir=\"ltr\"></html>"),
    ("<body class=x><p>1</p></body></html><!--end-->", "<html><head></head><body class=\"x\"><p>1</p></body></html><!--end-->"),
    ("<noscript><p>x</p></noscript>", "<html><head><noscript><p>x</p></noscript></head></html>"),
    ("<form><form><input></form>x", page("<form><input></form>x")),
    ("<select><option>1<option>2</select>", page("<select><option>1</option><option>2</option></select>")),
    ("<button>1<button>2", page("<button>1</button><button>2</button>")),
    ("<image src=x>", page("<img src=\"x\">")),
    ("x</br>y", page("x<br>y")),
    ("<p>1</body>2", page("<p>12</p>")),
    ("<!DOCTYPE html><head></head><title>t</title><p>", "<!DOCTYPE html><html><head><title>t</title></head><body><p></p></body></html>"),
    ("<template><p>1</template><div>2", "<html><head><template><p>1</p></template><div>2</div></head></html>"),
    ("<textarea><b>x</textarea>y", page("<textarea>x</textarea>y")),
]


@pytest.mark.parametrize("html,want", HTML)
def test_html(html, want):
    assert to_html(parse(html)) == want


def test_html_spec():
    out = lambda h: to_html(parse(h, SPEC))
    assert out("<script>var t=\"</p>\";</script><p>x &amp; y") == "<html><head><script>var t=\"</p>\";</script></head><body><p>x &amp; y</p></body></html>"
    assert out("<picture><source srcset=l><img src=s></picture>") == page("<picture><source srcset=\"l\"><img src=\"s\"></picture>")
    assert out("<dl><dt>A<dd>B</dl>") == page("<dl><dt>A</dt><dd>B</dd></dl>")
    assert out("<svg><circle/><path/></svg>x") == page("<svg><circle></circle><path></path></svg>x")
    assert out("") == "<html><head></head><body></body></html>"


def test_output_options():
    t = parse("<!DOCTYPE html><div><p>a</p><br></div>")
    assert to_html(t, 0, HtmlOptions(include_doctype=False)) == page("<div><p>a</p><br></div>")
    pretty = to_html(t, 0, HtmlOptions(pretty=True))
    assert pretty.startswith("<!DOCTYPE html>\n<html>\n  <head></head>\n  <body>\n    <div>\n      <p>\na      </p>\n      <br>\n    </div>\n")
    assert "#text 'a'" in dump(t)
    assert to_html(parse("<a title='\"&<'>&<b></a>")) == page("<a title=\"&quot;&amp;<\">&amp;<b></b></a>")


def test_deep_and_wide():
    deep = "<div>" * 3000 + "Deep"
    t = parse(deep)
    assert to_html(t).count("<div>") == 3000 and to_text(t) == "Deep" and to_markdown(t) == "Deep\n"
    assert len(Matcher(t).query_all("div div")) == 2999
    assert to_html(clean(t)).count("<div>") == 3000
    assert len(Matcher(parse("<ul>" + "<li>x" * 500)).query_all("li:nth-child(odd)")) == 250


COUNTS = [
    ("<div><div></div></div>", "div", 2), ("<div></div>", "DIV", 1), ("<div id=test></div><span id=test></span>", "#test", 2),
    ("<div class='a b c'></div><div class='a b'></div>", ".a.b.c", 1), ("<div class='a b c'></div><div class='a b'></div>", ".a.b", 2),
    ("<div><p><span></span></p></div>", "div span", 1), ("<ul><li><li><li><li></ul>", "li:nth-child(even)", 2), ("<ul><li><li><li><li><li><li></ul>", "li:nth-child(2n+1)", 3),
    ("<ul><li><li></ul>", "li:nth-child(0)", 0), ("<ul><li><li></ul>", "li:nth-child(-1)", 0), ("<ul><li><li></ul>", "li:nth-child(invalid)", 0),
    ("<ul><li><li><li></ul>", "li:nth-last-child(-n+2)", 2), ("<div>   </div><div></div>", "div:empty", 2), ("<div><!-- c --></div><div>x</div>", "div:empty", 1),
    ("<a href='test'></a>", "[href^='']", 1), ("<a href='test'></a>", "[href*='es']", 1), ("<a href='test'></a>", "[href$=ST i]", 1), ("<a href></a>", "[href='']", 0), ("<a href></a>", "[href]", 1),
    ("<p lang=en-US></p><p lang=en></p><p lang=enx></p>", "[lang|=en]", 2), ("<p class='x y'></p>", "[class~=y]", 1),
    ("<div><a></a><b></b><c></c><d></d></div>", "a + b + c + d", 1), ("<div><x></x><y></y><z></z></div>", "x + y", 1), ("<div><p></p><ul></ul>t<ol></ol></div>", "p + ul + ol", 1),
    ("<div><p></p><i></i><ul></ul></div>", "p ~ ul", 1), ("<div><p></p><hr><ul></ul></div>", "p ~ ul", 1), ("<div class='a b'></div>", ".a, .b", 1), ("", "div", 0),
    ("<div></div>", "html:root", 1), ("<div></div><span></span>", ":not(*)", 0), ("<div><span></span></div>", "  div  ", 1), ("<div></div>", ":not()", 4),
    ("<div></div>", "div > > span", 1), ("<div></div>", "> div", 1), ("<div></div>", "div >", 1), ("<a><b><x><b><c></c></b></x></b></a>", "a > b c", 0),
    ("<div><p>x</p></div><div></div>", "div:has(p)", 0), ("<input disabled><input><button></button>", ":enabled", 2), ("<input checked>", ":checked", 1),
    ("<input required><select></select><p></p>", ":optional", 1), ("<input readonly><textarea></textarea>", ":read-write", 1), ("<input placeholder=x>", ":placeholder-shown", 1),
    ("<div><p></p><p></p><ul></ul></div>", "p:last-of-type", 1), ("<div><p></p><ul></ul></div>", ":only-of-type", 6), ("<div><p></p><p></p></div>", "p:nth-last-of-type(2)", 1),
    ("<ul><li class=a><li></ul>", "li:is(.a, :last-child)", 2), ("<ul><li class=a><li></ul>", "li:not(.a)", 1), ("<p></p>", ":unknown", 0), ("<p></p>", ":where(p, div)", 1),
]


@pytest.mark.parametrize("html,selector,count", COUNTS)
def test_selector(html, selector, count):
    assert len(Matcher(parse(html)).query_all(selector)) == count


@pytest.mark.parametrize("html,selector,count", [
    ("<a><b><x><b><c></c></b></x></b></a>", "a > b c", 1), ("<div><p>x</p></div><div></div>", "div:has(p)", 1), ("<div><b><p>x</p></b></div>", "div:has(> p)", 0),
    ("<p>one</p><p>two</p>", "p:contains('tw')", 1), ("<input type=\"\">", "[type=\"\"]", 1),
    ("<p class=my:class></p>", ".my\\:class", 1), ("<p id=a#b></p>", "#a\\#b", 1), ("<p class=icon></p>", ".\\69 con", 1), ("<p data-x=test></p>", "[ data-x = 'test' ] , [ data-x ]", 1),
])
def test_selector_spec(html, selector, count):
    assert len(Matcher(parse(html, SPEC), SPEC).query_all(selector)) == count


@pytest.mark.parametrize("selector", ["", "   ", "%", "#", ".", "[", "[a", "[a=", "[a='x]", "a:", ":not(a", ":is(a", "[=x]", "\"x", "[ a ]"])
def test_selector_errors(selector):
    with pytest.raises(SelectorError):
        parse_selector(selector)


def test_nth():
    args = {"2": (0, 2), "odd": (2, 1), "even": (2, 0), "2n": (2, 0), "2n+1": (2, 1), "n+3": (1, 3), "-n+3": (-1, 3), " 2N + 1 ": (2, 1), "+n": (1, 0), "x": None, "": None, "2n+": None, "99999999999": None}
    assert {a: parse_nth(a) for a in args} == args
    assert [i for i in range(7) if nth(i, (-1, 3))] == [1, 2, 3]


CLEAN = [
    ("<p>Hello<script>alert(1)</script> <a href=\"javascript:alert(1)\">bad</a></p>", "<p>Hello<></> <a>bad</a></p>"),
    ("<!DOCTYPE html><p>x</p>", "<!DOCTYPE html><p>x</p>"), ("<p>x<!-- c --></p>", "<p>x<!----></p>"), ("<img src=\"http://h/a.png\"><img src=\"a.png\">", "<img><img src=\"a.png\">"),
    ("<a href=\"/p?t=a:b\">x</a>", "<a>x</a>"), ("<a href=\"//h/x\">x</a>", "<a href=\"//h/x\">x</a>"), ("<custom-tag>Keep</custom-tag>", "Keep"),
    ("<div onclick=x class=c>y</div>", "<div class=\"c\">y</div>"), ("<a href=\" JavaScript:x\">y</a>", "<a>y</a>"), ("<svg><g>t</g></svg>", "t"), ("<a href=\"#f\" target=_blank>y</a>", "<a href=\"#f\">y</a>"),
]


@pytest.mark.parametrize("html,want", CLEAN)
def test_clean(html, want):
    assert to_html(clean(parse(html))) == want


def test_clean_spec():
    out = lambda h: to_html(clean(parse(h, SPEC), 0, DEFAULT_POLICY, SPEC))
    assert out("<!DOCTYPE html><p>x<!-- c --><script>1</script></p>") == "<p>x</p>"
    assert out("<a href='javascript&colon;x' title='&amp;'>y</a>") == "<a href=\"javascript&amp;colon;x\" title=\"&amp;\">y</a>"
    assert out("<a href='javascript&#58;x'>y</a>") == "<a>y</a>"


def test_policies():
    with pytest.raises(UnsafeHtmlError, match="Unsafe HTML: Disallowed tag: script"):
        clean(parse("<p>x</p><script>1</script>"), 0, DEFAULT_POLICY.but(unsafe_handling="raise", allowed_tags=DEFAULT_POLICY.allowed_tags | {"html", "head", "body"}))
    found = []
    clean(parse("<script>1</script><iframe></iframe>"), 0, DEFAULT_POLICY.but(unsafe_handling="collect"), errors=found)
    assert len(found) >= 2 and {(e.category, e.code) for e in found} == {("security", "unsafe-html")}
    only_p = SanitizationPolicy(allowed_tags=frozenset(("p",)))
    assert to_html(clean(parse("<div><p class=x>T</p></div>"), 0, only_p)) == "<p>T</p>"
    drop = only_p.but(strip_disallowed_tags=False, allowed_tags=frozenset(("p", "html", "body")))
    assert to_html(clean(parse("<div><b>x</b></div><p>y"), 0, drop)) == "<html><></><body><><></></><p>y</p></body></html>"
    rel = DEFAULT_POLICY.but(force_link_rel=frozenset(("noopener", "nofollow")))
    assert to_html(clean(parse("<a href=x>y</a>"), 0, rel)) == "<a href=\"x\" rel=\"nofollow noopener\">y</a>"
    proxy = UrlPolicy(allow_rules={("a", "href"): UrlRule(handling="proxy")}, proxy=UrlProxy("https://px/?a=1", "u"))
    assert to_html(clean(parse("<a href='http://x/a b~'>y</a>"), 0, DEFAULT_POLICY.but(url_policy=proxy))) == "<a href=\"https://px/?a=1&amp;u=http%3A%2F%2Fx%2Fa%20b~\">y</a>"


@pytest.mark.parametrize("url,ok", [
    ("https://example.com", True), ("mailto:test@example.com", True), ("javascript:alert(1)", False), ("data:text/html,<script>", False), ("#s", True), ("#", True), ("/path", True),
    ("../parent", True), ("./c", True), ("", False), ("  ", False), ("HTTP://x", True), ("//h/x", True),
])
def test_urls(url, ok):
    assert UrlPolicy().check_url(UrlRule.with_schemes("http", "https", "mailto"), url) is ok


def test_css_filter():
    policy = DEFAULT_POLICY.but(allowed_attributes={"*": frozenset(("style",))}, allowed_css_properties=frozenset(("color",)))
    html = "<p style='color: red; position: fixed'>x</p>"
    assert to_html(clean(parse(html), 0, policy)) == "<p style=\"color: red; position: fixed\">x</p>"
    assert to_html(clean(parse(html, SPEC), 0, policy, SPEC)) == "<p style=\"color: red\">x</p>"


def test_hosts():
    assert [extract_host(u) for u in ("https://example.com/path", "http://test.org:8080/", "mailto:x", "http:///x")] == ["example.com", "test.org", None, None]
    rule = UrlRule(frozenset(("https",)), allowed_hosts=frozenset(("a.org",)))
    assert [UrlPolicy().check_url(rule, u) for u in ("https://A.org/x", "https://b.org", "https:///x", "//a.org")] == [True, False, False, True]


MARKDOWN = [
    ("<h1>Title</h1>", "# Title\n"), ("<p>Hello <b>world</b>!</p>", "Hello **world**!\n"), ("<p>a <b>b</b> c</p>", "a **b**c\n"), ("<ol><li>First</li><li>Second</li></ol>", "1. First\n2. Second\n"),
    ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b\n"), ("<pre><code>fn  main() {}</code></pre>", "```\nfn  main() {}\n```\n"), ("<p>This is <del>x</del></p>", "This is ~~x~~\n"),
    ("<style>p{}</style><p>x</p>", "p{}\n\nx\n"), ("<a href=u>t</a><img src=s alt=a>", "[t](u)![a](s)\n"), ("<blockquote>a\nb</blockquote>", "> a\n> b\n"), ("a<hr>b", "a\n\n---\n\nb\n"), ("a<br>b", "a  \nb\n"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "| 1 | 2 |\n"), ("<i>a</i><u>b</u><code>c</code>", "*a**b*`c`\n"), ("", ""),
]


@pytest.mark.parametrize("html,want", MARKDOWN)
def test_markdown(html, want):
    assert to_markdown(parse(html)) == want


def test_markdown_options():
    assert to_markdown(parse("<h1>T</h1><h2>U</h2>"), 0, MarkdownOptions(atx_headers=False)) == f"T\n{'=' * 20}\n\nU\n{'-' * 20}\n"
    assert to_markdown(parse("<ul><li><i>a</i>"), 0, MarkdownOptions(bullet_char="*", emphasis_char="_")) == "* _a_\n"
    assert to_markdown(parse("<p>a <b>b</b> c</p>", SPEC), 0, MarkdownOptions(), SPEC) == "a **b** c\n"


def test_text():
    t = parse("<title>T</title><style>s</style><div>a<p>b</p>c</div>d")
    assert to_text(t) == "Tabcd"
    assert to_text(t, 0, "block") == "T\na\nb\nc\nd"


PARTS = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<td>", "</table>", "text ", "<br>", "<!--c-->", "<script>", "</script>", "<h1>", "</h1>", "<a href='x:y'>", "</a>", "<template>", "</template>", "</body>", "<form>", "</form>"]


def test_invariants():
    r = random.Random(5)
    for _ in range(300):
        html = "".join(r.choice(PARTS) for _ in range(r.randrange(40)))
        for options in (ParseOptions(), SPEC):
            t = parse(html, options)
            at = places(t)
            assert at.order == t.walk() and len(at.order) == len(t.kind)
            for i in at.order[1:]:
                p = t.parent[i]
                assert at.pre[p] < at.pre[i] <= at.last[i] <= at.last[p] and i in t.children[p]
            for i in at.order:
                kids = [c for c in t.children[i] if t.kind[c] == ELEMENT]
                assert [at.elem[c] for c in kids] == list(range(1, len(kids) + 1))
            c = clean(t, 0, DEFAULT_POLICY, options)
            left = {c.name[i] for i in c.walk() if c.kind[i] == ELEMENT}
            assert left <= DEFAULT_POLICY.allowed_tags | {""}
            assert to_html(parse(to_html(t), options)) is not None
