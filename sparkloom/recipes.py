"""Named queries over the table `pages`, with SQL that DuckDB can hold against them where there is some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from .html.clean import DEFAULT_POLICY, UrlProxy, UrlRule
from .operators import documents as D
from .operators import tree as T
from .plans import compile as P

PROXY = UrlProxy("https://proxy.example/?a=1", "u")
WEB = UrlRule.with_schemes("http", "https", "mailto")


def pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return D.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", *more))


def _matches(spark: SparkSession, sf_dir: str, selector: str, fmt: str = "text", **options) -> DataFrame:
    found = D.select(pages(spark, sf_dir), selector, fmt, "page_id", **options)
    return found.withColumnRenamed("doc_id", "page_id").withColumnRenamed("content", fmt)


def _links(spark: SparkSession, sf_dir: str, selector: str, **options) -> DataFrame:
    return _matches(spark, sf_dir, selector, **options).select("page_id", "ord", P.attr("href").alias("href"), "text")


def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the navigation, in document order."""
    return _links(spark, sf_dir, "nav ul li a[href]")


def nav_links_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the node table, by joins."""
    nodes = D.nodes(pages(spark, sf_dir), "page_id")
    return P.query_all(nodes, "nav ul li a[href]").select(F.col("doc_id").alias("page_id"), P.attr("href").alias("href"))


def odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, "li:nth-child(odd) > a")


def first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, "a", first=True).drop("ord")


def last_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, "li:last-child > a").drop("ord")


def letter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose target begins with /t in either case."""
    return _links(spark, sf_dir, '[href^="/t" i]').drop("ord")


def _render(fmt: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages(spark, sf_dir).select("page_id", D.rendered("html", fmt, **options).alias(fmt))

    return run


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "title").select("page_id", F.col("text").alias("title"), X.html_escape("text").alias("escaped"), X.attr_escape("text").alias("quoted"), X.normalize_space("text").alias("spaced"))


def page_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, character set and document type of each page."""
    nodes = D.nodes(pages(spark, sf_dir), "page_id", fields=("doc_id", "kind", "name", "attrs", "doctype"))
    pick = lambda cond, value: F.max(F.when(cond, value))
    return nodes.groupBy(F.col("doc_id").alias("page_id")).agg(
        pick(F.col("name") == "html", P.attr("lang")).alias("lang"),
        pick(F.col("name") == "meta", P.attr("charset")).alias("charset"),
        pick(F.col("kind") == "doctype", F.col("doctype.name")).alias("doctype"),
    )


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.nodes(pages(spark, sf_dir), "page_id", fields=("doc_id", "name")).where(F.col("name").isin("a", "b", "br", "li", "p", "h1", "article"))
    return nodes.groupBy(F.col("doc_id").alias("page_id"), "name").agg(F.count(F.lit(1)).alias("n"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = D.tokens(pages(spark, sf_dir), "page_id").where(F.col("kind").isin("start", "end", "comment", "doctype"))
    return tokens.groupBy(F.col("doc_id").alias("page_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(pages(spark, sf_dir), "page_id", fields=("doc_id", "kind", "data")).where("kind = 'comment'").select(F.col("doc_id").alias("page_id"), "data")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "div.ad").select("page_id", "text")


def link_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default policy makes of the navigation's links."""
    rule = DEFAULT_POLICY.url_policy.get_rule("a", "href")
    return nav_links(spark, sf_dir).select("page_id", "ord", "href", X.url_allowed("href", rule, DEFAULT_POLICY.url_policy).alias("allowed"))


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, rule and proxy of the pages' own URLs, without Python."""
    hosts = UrlRule(frozenset(("http",)), allowed_hosts=frozenset(("example.com",)))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", X.url_host("url").alias("host"), X.url_allowed("url", WEB).alias("web"), X.url_allowed("url", hosts).alias("listed"), X.url_proxy("url", PROXY).alias("proxied")
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, inline handlers and outside resources of each page."""
    nodes = D.nodes(pages(spark, sf_dir), "page_id", fields=("doc_id", "kind", "name", "attrs")).where("kind = 'element'")
    n = lambda cond: F.count_if(cond).cast("bigint")
    outside: Column = F.coalesce(F.startswith(F.coalesce(P.attr("src"), P.attr("href")), F.lit("http")), F.lit(False))
    return nodes.groupBy(F.col("doc_id").alias("page_id")).agg(
        n(F.col("name") == "script").alias("scripts"), n(F.exists("attrs", lambda a: F.startswith(a["name"], F.lit("on")))).alias("handlers"), n(outside).alias("outside"),
    )


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.errors(pages(spark, sf_dir), "page_id")
    return e.select(F.col("doc_id").alias("page_id"), "err_ord", "code", X.error_display("code", "message", "line", "col").alias("shown"))


def safe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = DEFAULT_POLICY.but(unsafe_handling="collect")
    return D.errors(pages(spark, sf_dir), "page_id", policy=policy).groupBy(F.col("doc_id").alias("page_id"), "code").agg(F.count(F.lit(1)).alias("n"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and first paragraph of each page."""
    title = _matches(spark, sf_dir, "title", first=True).select("page_id", F.col("text").alias("title"))
    first = _matches(spark, sf_dir, "article p", first=True).select("page_id", F.col("text").alias("summary"))
    return title.join(first, "page_id", "left")


def node_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written from their node rows, in one pass over rows that are dealt by page."""
    return T.to_html(D.nodes(pages(spark, sf_dir), "page_id", fields=T.HTML_FIELDS)).select(F.col("doc_id").alias("page_id"), "html")


def list_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the list items by their ancestors."""
    nodes = D.nodes(pages(spark, sf_dir), "page_id")
    found = T.ancestors(nodes, nodes.where("name = 'li'"))
    return found.groupBy(F.col("doc_id").alias("page_id"), "name").agg(F.count_distinct("from_id").alias("n"))


def spec_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", D.rendered("html", "text", profile="spec").alias("text"))


QUERIES = {
    "nav_links": nav_links, "nav_links_joined": nav_links_joined, "odd_links": odd_links, "first_link": first_link, "last_link": last_link, "letter_links": letter_links,
    "page_text": _render("text"), "page_block_text": _render("block_text"), "page_html": _render("html"), "page_pretty": _render("pretty"), "page_markdown": _render("markdown"),
    "page_tree": _render("tree"), "safe_html": _render("html", policy=DEFAULT_POLICY), "safe_markdown": _render("markdown", policy=DEFAULT_POLICY),
    "safe_text": _render("text", policy=DEFAULT_POLICY), "spec_text": spec_text, "page_title": page_title, "page_head": page_head, "tag_counts": tag_counts,
    "token_counts": token_counts, "comments": comments, "ads": ads, "link_policy": link_policy, "url_checks": url_checks, "audit": audit, "parse_errors": parse_errors,
    "safe_findings": safe_findings, "summaries": summaries, "node_html": node_html, "list_ancestors": list_ancestors,
}

_LINKS = """
with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 1) as hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 2) as texts from pages),
u as (select page_id, len(hrefs) as n, unnest(range(1, len(hrefs) + 1)) as i, hrefs, texts from l),
links as (select page_id, n, (i - 1)::int as ord, hrefs[i] as href, texts[i] as text from u)
"""
# what is cut off at the end of a page is no construct; text and tags are taken out one kind at a time
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '<!--[^>]*-->', '', 'g'), '{script}', '', 'g'), '<style>[^<]*(</style>|$)', '', 'g')"""
_TEXT = r"regexp_replace(" + _BARE.replace("{script}", "<script>[^<]*(</p>|$)") + r", '<[^>]*(>|$)', '', 'g')"

ORACLE_SQL = {
    "nav_links": _LINKS + "select page_id, ord, href, text from links",
    "nav_links_joined": _LINKS + "select page_id, href from links",
    "odd_links": _LINKS + "select page_id, (ord // 2)::int as ord, href, text from links where ord % 2 = 0",
    "first_link": _LINKS + "select page_id, href, text from links where ord = 0",
    "last_link": _LINKS + "select page_id, href, text from links where ord = n - 1",
    "letter_links": _LINKS + "select page_id, href, text from links where lower(href[1:2]) = '/t'",
    "page_text": f"select page_id, {_TEXT} as text from pages",
    "safe_text": f"select page_id, {_TEXT} as text from pages",
    "spec_text": rf"""select page_id, regexp_replace(regexp_replace(replace(replace(regexp_replace({_BARE.replace('{script}', '<script>.*?(</script>|$)').replace("'g')", "'gs')", 2)}, '<[^>]*(>|$)', '', 'g'), '&copy;', '©'), '&middot;', '·'),
 '&quot;?', '"', 'g'), '&amp;?', '&', 'g') as text from pages""",
    "parse_errors": """select page_id, i::int as err_ord, c as code, case when i < 2 then c || ' - Unexpected </unknown> end tag' else c || ' - Unexpected <unknown> start tag' end as shown
 from (select page_id, unnest(range(3)) as i, case when i < 2 then 'unexpected-end-tag' else 'unexpected-start-tag' end as c from pages where html like '%<body>%')""",
    "safe_findings": """select page_id, 'unsafe-html' as code, (2 + len(regexp_extract_all(html, '<(html|head|meta|title|style|script|nav|article|footer)( [^>]*)?>')))::bigint as n from pages""",
    "page_title": r"""select page_id, t as title, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, replace(replace(t, '&', '&amp;'), '"', '&quot;') as quoted,
 regexp_replace(regexp_replace(t, '^\s+', ''), '\s+', ' ', 'g') as spaced from (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as t from pages where html like '%<title>%')""",
    "page_head": """select page_id, nullif(regexp_extract(html, '<html lang="([^"]*)">', 1), '') as lang, nullif(regexp_extract(html, '<meta charset="([^"]*)">', 1), '') as charset,
 lower(nullif(regexp_extract(html, '<!DOCTYPE ([^>]*)>', 1), '')) as doctype from pages""",
    "tag_counts": r"""select page_id, name, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<(a|b|br|li|p|h1|article)( [^>]*)?>', 1)) as name from pages) group by all""",
    "token_counts": r"""select page_id, kind, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<!--|<!D|</?[a-z]', 0)) as x, case x when '<!--' then 'comment' when '<!D' then 'doctype' else
 case when x[2] = '/' then 'end' else 'start' end end as kind from (select page_id, regexp_replace(html, '<[^>]*$', '') as html from pages)) group by all""",
    "comments": "select page_id, unnest(regexp_extract_all(html, '<!--([^>]*)-->', 1)) as data from pages",
    "ads": """select page_id, unnest(regexp_extract_all(html, '<div class="ad">([^<]*)', 1)) as text from pages""",
    "link_policy": _LINKS + "select page_id, ord, href, href <> '' and (href not like '%:%' or regexp_extract(href, '^([^:]*):', 1) in ('http', 'https', 'mailto', 'tel')) as allowed from links",
    "url_checks": r"""select page_id, nullif(regexp_extract(url, '://([^/:?#]*)', 1), '') as host, regexp_extract(url, '^([^:]*):', 1) in ('http', 'https', 'mailto') as web,
 regexp_extract(url, '^([^:]*):', 1) = 'http' and regexp_extract(url, '://([^/:?#]*)', 1) = 'example.com' as listed, 'https://proxy.example/?a=1&u=' || url_encode(url) as proxied from pages""",
    "audit": r"""select page_id, len(regexp_extract_all(html, '<script>'))::bigint as scripts, 0::bigint as handlers, len(regexp_extract_all(html, '(src|href)="http[^"]*"[^>]*>'))::bigint as outside from pages""",
    "list_ancestors": """select page_id, unnest(['html', 'body', 'nav', 'ul', '#document']) as name, n from (select page_id, len(regexp_extract_all(html, '<li>'))::bigint as n from pages) where n > 0""",
    "summaries": r"""with t as (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, regexp_extract(html, '<article>.*', 0, 's') as a from pages where html like '%<title>%'),
p as (select page_id, title, a, position('<p>' in a) as k from t),
q as (select page_id, title, k, regexp_extract(substr(a, k + 3), '^(.*?)(<p>|</p>|<footer|$)', 1, 's') as x from p)
select page_id, title, case when k > 0 then regexp_replace(x, '<[^>]*(>|$)', '', 'g') end as summary from q""",
}
