"""Inputs with what is expected of them, as queries: each is run once for each page, whose id stands in place of §.

Expected values are stated, not computed: DuckDB lists them next to the ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as X
from .html.clean import DEFAULT_POLICY, UrlRule
from .operators import documents as D
from .operators import tree as T

# fixed values: what the standard or the observed engine makes of an input
# fmt: off
TOKENS = [
    ("<p>Hello§</p>", ["start p", "chars Hello§", "end p"]),
    ("<br/>", ["start br /"]),
    ("<br / >", ["start br"]),
    ("<!-- c -->", ["comment  c "]),
    ("<input type=\"checkbox\" checked>", ["start input type=checkbox checked"]),
    ("<DIV CLASS='Test'>", ["start div class=Test"]),
    ("a <", ["chars a "]),
    ("a < b", ["chars a ", "chars < b"]),
    ("<<b>", ["chars <", "start b"]),
    ("&lt;", ["chars &lt;"]),
    ("<input type=\"\">", ["start input type"]),
    ("<a x=1 x=2>", ["start a x=1"]),
    ("<a x=1/>y", ["start a x=1/", "chars y"]),
    ("<a =x>", ["start a =x"]),
    ("<a b = \"c\"d>", ["start a b=c d"]),
    ("<a b= >", ["start a b"]),
    ("<a/b/>", ["start a b /"]),
    ("<a\n b\t=\fc>", ["start a b=c"]),
    ("<![CDATA[Some <text> & stuff]]>", ["comment Some <text", "chars  & stuff]]>"]),
    ("<?xml v?>x", ["comment ?xml v?", "chars x"]),
    ("</>x", ["chars x"]),
    ("</ x>y", ["comment  x", "chars y"]),
    ("<!>x>y", ["comment >x", "chars y"]),
    ("<!-->x", ["comment ", "chars x"]),
    ("<!--->x", ["comment ", "chars x"]),
    ("<!----->", ["comment -"]),
    ("<!--a--!>b", ["comment a", "chars b"]),
    ("\ufeffx", ["chars x"]),
    ("<!doctype html>", ["doctype html - - false"]),
    ("<!DOCTYPE>", ["doctype - - - true"]),
    ("<!DOCTYPE HTML PUBLIC \"-//W3C//DTD HTML 4.01//EN\" \"u\">", ["doctype html - - true"]),
    ("<!dog>", ["comment dog"]),
]
PAGES = [
    ("<!-- c -->", "<!-- c -->"),
    ("<p>Hello§</p>", "<html><head></head><body><p>Hello§</p></body></html>"),
    ("<p>a &amp; b", "<html><head></head><body><p>a &amp;amp; b</p></body></html>"),
    ("<b><i>x</b>y</i>", "<html><head></head><body><b><i>xy</i></b></body></html>"),
    ("<picture><source srcset=\"l\"><img src=\"s\"></picture>", "<html><head></head><body><picture><source srcset=\"l\"></picture></body></html>"),
    ("<table><tr><td>A<td>B</table>", "<html><head></head><body><table><tr><td>A<td>B</td></td></tr></table></body></html>"),
    ("<table><tr><td>A<td>B</table>C", "<html><head></head><body><table><tr><td>A<td>BC</td></td></tr></table></body></html>"),
    ("<dl><dt>A<dd>B</dl>", "<html><head></head><body><dl><dt>A<dd>B</dd></dt></dl></body></html>"),
    ("<ul><li>A<li>B</ul>", "<html><head></head><body><ul><li>A</li><li>B</li></ul></body></html>"),
    ("<p>A<p>B", "<html><head></head><body><p>A</p><p>B</p></body></html>"),
    ("<div></p></div>", "<html><head></head><body><div><p></p></div></body></html>"),
    ("<script>var t=\"</p>\";f();</script><p>x", "<html><head><script>var t=\"</script></head><body>\";f();<p>x</p></body></html>"),
    ("<title>a <b>c</b> d</title>", "<html><head><title>a c</title></head><body> d</body></html>"),
    ("<div/>x", "<html><head></head><body><div>x</div></body></html>"),
    ("<h1>a<h2>b", "<html><head></head><body><h1>a</h1><h2>b</h2></body></html>"),
    ("<a>1<a>2", "<html><head></head><body><a>1<a>2</a></a></body></html>"),
    ("<html lang=en><html lang=de dir=ltr>", "<html lang=\"en\" dir=\"ltr\"></html>"),
    ("<body class=x><p>1</p></body></html><!--end-->", "<html><head></head><body class=\"x\"><p>1</p></body></html><!--end-->"),
    ("<noscript><p>x</p></noscript>", "<html><head><noscript><p>x</p></noscript></head></html>"),
    ("<form><form><input></form>x", "<html><head></head><body><form><input></form>x</body></html>"),
    ("<select><option>1<option>2</select>", "<html><head></head><body><select><option>1</option><option>2</option></select></body></html>"),
    ("<button>1<button>2", "<html><head></head><body><button>1</button><button>2</button></body></html>"),
    ("<image src=x>", "<html><head></head><body><img src=\"x\"></body></html>"),
    ("x</br>y", "<html><head></head><body>x<br>y</body></html>"),
    ("<p>1</body>2", "<html><head></head><body><p>12</p></body></html>"),
    ("<!DOCTYPE html><head></head><title>t</title><p>", "<!DOCTYPE html><html><head><title>t</title></head><body><p></p></body></html>"),
    ("<template><p>1</template><div>2", "<html><head><template><p>1</p></template><div>2</div></head></html>"),
    ("<textarea><b>x</textarea>y", "<html><head></head><body><textarea>x</textarea>y</body></html>"),
]
CLEAN = [
    ("<p>Hello§<script>alert(1)</script> <a href=\"javascript:alert(1)\">bad</a></p>", "<p>Hello§<></> <a>bad</a></p>"),
    ("<!DOCTYPE html><p>x</p>", "<!DOCTYPE html><p>x</p>"),
    ("<p>x<!-- c --></p>", "<p>x<!----></p>"),
    ("<img src=\"http://h/a.png\"><img src=\"a.png\">", "<img><img src=\"a.png\">"),
    ("<a href=\"/p?t=a:b\">x</a>", "<a>x</a>"),
    ("<a href=\"//h/x\">x</a>", "<a href=\"//h/x\">x</a>"),
    ("<custom-tag>Keep</custom-tag>", "Keep"),
    ("<div onclick=x class=c>y</div>", "<div class=\"c\">y</div>"),
    ("<a href=\" JavaScript:x\">y</a>", "<a>y</a>"),
    ("<svg><g>t</g></svg>", "t"),
    ("<a href=\"#f\" target=_blank>y</a>", "<a href=\"#f\">y</a>"),
]
MARKDOWN = [
    ("<h1>Title§</h1>", "# Title§\n"),
    ("<p>Hello§ <b>world</b>!</p>", "Hello§ **world**!\n"),
    ("<p>a <b>b</b> c</p>", "a **b**c\n"),
    ("<ol><li>First§</li><li>Second</li></ol>", "1. First§\n2. Second\n"),
    ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b\n"),
    ("<pre><code>fn  main() {}</code></pre>", "```\nfn  main() {}\n```\n"),
    ("<p>This is <del>x</del></p>", "This is ~~x~~\n"),
    ("<style>p{}</style><p>x</p>", "p{}\n\nx\n"),
    ("<a href=u>t</a><img src=s alt=a>", "[t](u)![a](s)\n"),
    ("<blockquote>a\nb</blockquote>", "> a\n> b\n"),
    ("a<hr>b", "a\n\n---\n\nb\n"),
    ("a<br>b", "a  \nb\n"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "| 1 | 2 |\n"),
    ("<i>a</i><u>b</u><code>c</code>", "*a**b*`c`\n"),
    ("", ""),
]
COUNTS = [
    ("<div><div></div></div>", "div", 2),
    ("<div></div>", "DIV", 1),
    ("<div id=test></div><span id=test></span>", "#test", 2),
    ("<div class='a b c'></div><div class='a b'></div>", ".a.b.c", 1),
    ("<div class='a b c'></div><div class='a b'></div>", ".a.b", 2),
    ("<div><p><span></span></p></div>", "div span", 1),
    ("<ul><li><li><li><li></ul>", "li:nth-child(even)", 2),
    ("<ul><li><li><li><li><li><li></ul>", "li:nth-child(2n+1)", 3),
    ("<ul><li><li></ul>", "li:nth-child(0)", 0),
    ("<ul><li><li></ul>", "li:nth-child(-1)", 0),
    ("<ul><li><li></ul>", "li:nth-child(invalid)", 0),
    ("<ul><li><li><li></ul>", "li:nth-last-child(-n+2)", 2),
    ("<div>   </div><div></div>", "div:empty", 2),
    ("<div><!-- c --></div><div>x</div>", "div:empty", 1),
    ("<a href='test'></a>", "[href^='']", 1),
    ("<a href='test'></a>", "[href*='es']", 1),
    ("<a href='test'></a>", "[href$=ST i]", 1),
    ("<a href></a>", "[href='']", 0),
    ("<a href></a>", "[href]", 1),
    ("<p lang=en-US></p><p lang=en></p><p lang=enx></p>", "[lang|=en]", 2),
    ("<p class='x y'></p>", "[class~=y]", 1),
    ("<div><a></a><b></b><c></c><d></d></div>", "a + b + c + d", 1),
    ("<div><x></x><y></y><z></z></div>", "x + y", 1),
    ("<div><p></p><ul></ul>t<ol></ol></div>", "p + ul + ol", 1),
    ("<div><p></p><i></i><ul></ul></div>", "p ~ ul", 1),
    ("<div><p></p><hr><ul></ul></div>", "p ~ ul", 1),
    ("<div class='a b'></div>", ".a, .b", 1),
    ("", "div", 0),
    ("<div></div>", "html:root", 1),
    ("<div></div><span></span>", ":not(*)", 0),
    ("<div><span></span></div>", "  div  ", 1),
    ("<div></div>", ":not()", 4),
    ("<div></div>", "div > > span", 1),
    ("<div></div>", "> div", 1),
    ("<div></div>", "div >", 1),
    ("<a><b><x><b><c></c></b></x></b></a>", "a > b c", 0),
    ("<div><p>x</p></div><div></div>", "div:has(p)", 0),
    ("<input disabled><input><button></button>", ":enabled", 2),
    ("<input checked>", ":checked", 1),
    ("<input required><select></select><p></p>", ":optional", 1),
    ("<input readonly><textarea></textarea>", ":read-write", 1),
    ("<input placeholder=x>", ":placeholder-shown", 1),
    ("<div><p></p><p></p><ul></ul></div>", "p:last-of-type", 1),
    ("<div><p></p><ul></ul></div>", ":only-of-type", 6),
    ("<div><p></p><p></p></div>", "p:nth-last-of-type(2)", 1),
    ("<ul><li class=a><li></ul>", "li:is(.a, :last-child)", 2),
    ("<ul><li class=a><li></ul>", "li:not(.a)", 1),
    ("<p></p>", ":unknown", 0),
    ("<p></p>", ":where(p, div)", 1),
]
ERRORS = [
    ("<a x=1 x=2>", ["(1,12): duplicate-attribute - Duplicate attribute name"]),
    ("<?x>", ["(1,3): unexpected-question-mark-instead-of-tag-name - Unexpected ? instead of tag name"]),
    ("\n</>", ["(2,4): missing-end-tag-name"]),
    ("<a 'b>", ["(1,5): unexpected-character-in-attribute-name - Unexpected character in attribute name"]),
    ("<a b=\"c\"d>", ["(1,10): missing-whitespace-between-attributes - Missing whitespace between attributes"]),
    ("<a b=c'd>", ["(1,8): unexpected-character-in-unquoted-attribute-value - Unexpected character in unquoted attribute value"]),
]
SPEC_COUNTS = [
    ("<a><b><x><b><c></c></b></x></b></a>", "a > b c", 1),
    ("<div><p>x</p></div><div></div>", "div:has(p)", 1),
    ("<div><b><p>x</p></b></div>", "div:has(> p)", 0),
    ("<p>one</p><p>two</p>", "p:contains('tw')", 1),
    ("<input type=\"\">", "[type=\"\"]", 1),
    ("<p class=my:class></p>", ".my\\:class", 1),
    ("<p id=a#b></p>", "#a\\#b", 1),
    ("<p class=icon></p>", ".\\69 con", 1),
    ("<p data-x=test></p>", "[ data-x = 'test' ] , [ data-x ]", 1),
]
URLS = [
    ("https://example.com", True),
    ("mailto:test@example.com", True),
    ("javascript:alert(1)", False),
    ("data:text/html,<script>", False),
    ("#s", True),
    ("#", True),
    ("/path", True),
    ("../parent", True),
    ("./c", True),
    ("", False),
    ("  ", False),
    ("HTTP://x", True),
    ("//h/x", True),
]
SPEC_PAGES = [
    ("<script>var t=\"</p>\";</script><p>x &amp; y", "<html><head><script>var t=\"</p>\";</script></head><body><p>x &amp; y</p></body></html>"),
    ("<picture><source srcset=l><img src=s></picture>", "<html><head></head><body><picture><source srcset=\"l\"><img src=\"s\"></picture></body></html>"),
    ("<dl><dt>A§<dd>B</dl>", "<html><head></head><body><dl><dt>A§</dt><dd>B</dd></dl></body></html>"),
    ("<svg><circle/><path/></svg>x", "<html><head></head><body><svg><circle></circle><path></path></svg>x</body></html>"),
    ("", "<html><head></head><body></body></html>"),
    ("<!DOCTYPE html PUBLIC \"p§\" 's'><p>x", "<!DOCTYPE html PUBLIC \"p§\" \"s\"><html><head></head><body><p>x</p></body></html>"),
    ("<!DOCTYPE html SYSTEM 's'>", "<!DOCTYPE html SYSTEM \"s\"><html><head></head><body></body></html>"),
    ("<title>a&amp;<b>§</title>", "<html><head><title>a&amp;&lt;b&gt;§</title></head><body></body></html>"),
    ("<p>&#0000000000000065;&#x41;§", "<html><head></head><body><p>AA§</p></body></html>"),
    ("<textarea>a<b>§</textarea>y", "<html><head></head><body><textarea>a&lt;b&gt;§</textarea>y</body></html>"),
]
# fmt: on


MARK = "§"


def _inputs(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """page_id, case_no, html, and a second text if there is one, for each page and case."""
    listed = F.array(*(F.struct(F.lit(k).alias("case_no"), F.lit(r[0]).alias("html"), F.lit(str(r[1])).alias("other")) for k, r in enumerate(rows)))
    ids = D.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"))
    return ids.select("page_id", F.inline(listed)).withColumn("html", F.replace("html", F.lit(MARK), F.col("page_id").cast("string")))


def _rendered(rows: list[tuple], fmt: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _inputs(spark, sf_dir, rows).select("page_id", "case_no", D.rendered("html", fmt, **options).alias("made"))

    return run


def _parts(rows: list[tuple], make):
    """For operators that give several rows a document: the document's id tells page and case."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = _inputs(spark, sf_dir, rows).select((F.col("page_id") * 1000 + F.col("case_no")).alias("doc_id"), "html")
        return make(some).withColumn("page_id", F.floor(F.col("doc_id") / 1000).cast("bigint")).withColumn("case_no", F.pmod("doc_id", F.lit(1000)).cast("int")).select("page_id", "case_no", "at", "made")

    return run


def _tokens(some: DataFrame) -> DataFrame:
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.coalesce(F.concat(F.lit("="), a["value"]), F.lit("")))), "")
    d = F.col("doctype")
    start = F.concat(F.lit("start "), "name", attrs, F.when(F.col("self_closing"), " /").otherwise(""))
    doctype = F.concat_ws(" ", F.lit("doctype"), *(F.coalesce(d[c], F.lit("-")) for c in ("name", "public_id", "system_id")), d["force_quirks"].cast("string"))
    made = F.when(F.col("kind") == "start", start).when(F.col("kind") == "doctype", doctype).otherwise(F.concat_ws(" ", "kind", F.coalesce("name", "data")))
    return D.tokens(some).select("doc_id", F.col("tok_ord").alias("at"), made.alias("made"))


def _errors(some: DataFrame) -> DataFrame:
    """Those of the tokens; the tree has some of its own."""
    found = D.errors(some).where("line is not null")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("err_ord")) - 1
    return found.select("doc_id", first.cast("int").alias("at"), X.error_display("code", "message", "line", "col").alias("made"))


def _counts(rows: list[tuple], profile: str = "observed"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = _inputs(spark, sf_dir, rows)
        return some.select("page_id", "case_no", D.match_count("html", "other", profile).alias("made"))

    return run


def case_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = UrlRule.with_schemes("http", "https", "mailto")
    return _inputs(spark, sf_dir, URLS).select("page_id", "case_no", X.url_allowed("html", rule).alias("made"))


# fixed values: a page for each order, and what is made of it; names in ⟨⟩ are columns
# fmt: off
ORDER = '<!DOCTYPE html><html lang="en"><head><title>Order ⟨k⟩</title></head><body><h1>Order ⟨k⟩</h1><p>Status <b>⟨s⟩</b> of "⟨p⟩" &amp; <a href="/orders/⟨k⟩?c=⟨c⟩" onclick="x()">customer ⟨c⟩</a></p><ul><li>total ⟨t⟩</li><li><i>late</i></li></ul><table><tr><td>⟨k⟩</td><td>⟨s⟩</td></tr></table><blockquote>quick comment</blockquote><hr><script>track(⟨k⟩);</script></body></html>'
ORDER_MADE = {
    "html": '<!DOCTYPE html><html lang="en"><head><title>Order ⟨k⟩</title></head><body><h1>Order ⟨k⟩</h1><p>Status <b>⟨s⟩</b> of "⟨p⟩" &amp;amp; <a href="/orders/⟨k⟩?c=⟨c⟩" onclick="x()">customer ⟨c⟩</a></p><ul><li>total ⟨t⟩</li><li><i>late</i></li></ul><table><tr><td>⟨k⟩</td><td>⟨s⟩</td></tr></table><blockquote>quick comment</blockquote><hr><script>track(⟨k⟩);</script></body></html>',
    "pretty": '<!DOCTYPE html>\n<html lang="en">\n  <head>\n    <title>Order ⟨k⟩</title>\n  </head>\n  <body>\n    <h1>\nOrder ⟨k⟩    </h1>\n    <p>\nStatus       <b>\n⟨s⟩      </b>\n of "⟨p⟩" &amp;amp;       <a href="/orders/⟨k⟩?c=⟨c⟩" onclick="x()">\ncustomer ⟨c⟩      </a>\n    </p>\n    <ul>\n      <li>\ntotal ⟨t⟩      </li>\n      <li>\n        <i>\nlate        </i>\n      </li>\n    </ul>\n    <table>\n      <tr>\n        <td>\n⟨k⟩        </td>\n        <td>\n⟨s⟩        </td>\n      </tr>\n    </table>\n    <blockquote>\nquick comment    </blockquote>\n    <hr>\n    <script>track(⟨k⟩);</script>\n  </body>\n</html>\n',
    "markdown": 'Order ⟨k⟩\n\n# Order ⟨k⟩\n\nStatus **⟨s⟩**of "⟨p⟩" &amp; [customer ⟨c⟩](/orders/⟨k⟩?c=⟨c⟩)\n\n- total ⟨t⟩\n- *late*\n\n| ⟨k⟩ | ⟨s⟩ |\n\n> quick comment\n\n---\n\ntrack(⟨k⟩);\n',
    "text": 'Order ⟨k⟩Order ⟨k⟩Status ⟨s⟩ of "⟨p⟩" &amp; customer ⟨c⟩total ⟨t⟩late⟨k⟩⟨s⟩quick comment',
    "block_text": 'Order ⟨k⟩\nOrder ⟨k⟩\nStatus ⟨s⟩ of "⟨p⟩" &amp; customer ⟨c⟩\ntotal ⟨t⟩\nlate\n⟨k⟩\n⟨s⟩\nquick comment\n',
    "tree": "#document\n  !doctype\n  html lang='en'\n    head\n      title\n        #text 'Order ⟨k⟩'\n    body\n      h1\n        #text 'Order ⟨k⟩'\n      p\n        #text 'Status '\n        b\n          #text '⟨s⟩'\n        #text ' of \"⟨p⟩\" &amp; '\n        a href='/orders/⟨k⟩?c=⟨c⟩' onclick='x()'\n          #text 'customer ⟨c⟩'\n      ul\n        li\n          #text 'total ⟨t⟩'\n        li\n          i\n            #text 'late'\n      table\n        tr\n          td\n            #text '⟨k⟩'\n          td\n            #text '⟨s⟩'\n      blockquote\n        #text 'quick comment'\n      hr\n      script\n        #text 'track(⟨k⟩);'",
    "safe_html": '<!DOCTYPE html>Order ⟨k⟩<h1>Order ⟨k⟩</h1><p>Status <b>⟨s⟩</b> of "⟨p⟩" &amp;amp; <a href="/orders/⟨k⟩?c=⟨c⟩">customer ⟨c⟩</a></p><ul><li>total ⟨t⟩</li><li><i>late</i></li></ul><table><tr><td>⟨k⟩</td><td>⟨s⟩</td></tr></table><blockquote>quick comment</blockquote><hr><></>',
    "safe_markdown": 'Order ⟨k⟩\n\n# Order ⟨k⟩\n\nStatus **⟨s⟩**of "⟨p⟩" &amp; [customer ⟨c⟩](/orders/⟨k⟩?c=⟨c⟩)\n\n- total ⟨t⟩\n- *late*\n\n| ⟨k⟩ | ⟨s⟩ |\n\n> quick comment\n\n---\n',
}
# fmt: on
ORDER_MADE["node_html"] = ORDER_MADE["html"]
_COLUMNS = {"k": "o_orderkey", "s": "o_orderstatus", "p": "o_orderpriority", "c": "o_custkey", "t": "floor(o_totalprice)::bigint"}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.lit(p) if n % 2 == 0 else F.expr(_COLUMNS[p]).cast("string") for n, p in enumerate(re.split("[⟨⟩]", ORDER)))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("doc_id"), F.concat(*parts).alias("html"))


def _order_query(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = D.spread(_orders(spark, sf_dir))
        if fmt == "node_html":
            made = T.to_html(D.nodes(some, fields=T.HTML_FIELDS)).select("doc_id", F.col("html").alias("made"))
        else:
            made = some.select("doc_id", D.rendered("html", fmt.removeprefix("safe_"), policy=DEFAULT_POLICY if fmt.startswith("safe_") else None).alias("made"))
        return made.withColumnRenamed("doc_id", "order_id")

    return run


def _order_sql(made: str) -> str:
    parts = ("'" + p.replace("'", "''") + "'" if n % 2 == 0 else f"({_COLUMNS[p]})::varchar" for n, p in enumerate(re.split("[⟨⟩]", made)))
    return f"select o_orderkey::bigint as order_id, {' || '.join(parts)} as made from orders"


QUERIES = {
    **{f"order_{fmt}": _order_query(fmt) for fmt in ORDER_MADE},
    "case_tokens": _parts(TOKENS, _tokens), "case_errors": _parts(ERRORS, _errors), "case_pages": _rendered(PAGES, "html"), "case_spec_pages": _rendered(SPEC_PAGES, "html", profile="spec"),
    "case_clean": _rendered(CLEAN, "html", policy=DEFAULT_POLICY), "case_markdown": _rendered(MARKDOWN, "markdown"), "case_counts": _counts(COUNTS), "case_spec_counts": _counts(SPEC_COUNTS, "spec"),
    "case_urls": case_urls,
}


def _sql(rows: list[tuple]) -> str:
    """The expected values beside every page."""
    kind = type(rows[0][-1])
    value = lambda w: "'" + w.replace("'", "''") + "'" if kind is str else str(w).lower()
    listed = ", ".join(f"({k}::int, {value(r[-1])})" for k, r in enumerate(rows))
    made = f"replace(made, '{MARK}', page_id::varchar) as made" if kind is str else "made::int as made" if kind is int else "made"
    return f"select page_id, case_no, {made} from pages, (values {listed}) v(case_no, made)"


def _sql_parts(rows: list[tuple]) -> str:
    listed = ", ".join(f"({k}::int, {at}::int, '" + w.replace("'", "''") + "')" for k, r in enumerate(rows) for at, w in enumerate(r[1]))
    return f"""select page_id, case_no, k as "at", replace(made, '{MARK}', page_id::varchar) as made from pages, (values {listed}) v(case_no, k, made)"""


ORACLE_SQL = {
    **{f"order_{fmt}": _order_sql(made) for fmt, made in ORDER_MADE.items()},
    "case_tokens": _sql_parts(TOKENS), "case_errors": _sql_parts(ERRORS), "case_pages": _sql(PAGES), "case_spec_pages": _sql(SPEC_PAGES), "case_clean": _sql(CLEAN),
    "case_markdown": _sql(MARKDOWN), "case_counts": _sql(COUNTS), "case_spec_counts": _sql(SPEC_COUNTS), "case_urls": _sql(URLS),
}
