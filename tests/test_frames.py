"""DataFrame operators against the single-document functions, and plans."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import sparkloom
from sparkloom import DEFAULT_POLICY, HtmlFrame, ParseOptions, SelectorError, UrlProxy, UrlRule, recipes, sources, streaming
from sparkloom import functions as X
from sparkloom import schema as S
from sparkloom.html.match import Matcher
from sparkloom.html.render import to_html
from sparkloom.html.tree import parse
from sparkloom.operators import documents as D
from sparkloom.operators import tree as T
from sparkloom.plans import compile as P

from test_documents import COUNTS, HTML


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)] + [(900, None)], "doc_id bigint, html string").cache()


def test_render_all(cases):
    got = dict(rows(HtmlFrame(cases).to_html()))
    assert got.pop(900) is None
    assert got == {i: want for i, (_, want) in enumerate(HTML)}


def test_node_html_equals_fused(cases):
    nodes = HtmlFrame(cases).nodes()
    joined = dict(rows(T.to_html(nodes)))
    assert {i: joined.get(i, "") for i in range(len(HTML))} == {i: want for i, (_, want) in enumerate(HTML)}
    text = dict(rows(T.to_text(nodes)))
    fused = {i: t or "" for i, t in rows(HtmlFrame(cases).to_text())}
    assert text == fused


def test_node_html_reads_nodes_once(spark, cases):
    """No table of parents or voids is sent to the driver, however small it looks, and nested raw elements tell their own text."""
    made = T.to_html(HtmlFrame(cases).nodes())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInArrow") == 2  # the parse and the writer
    kinds = [("document", "#document", None, 1, 6, 0, 1, None), ("element", "style", None, 2, 6, 1, 2, 1), ("element", "script", None, 3, 4, 2, 3, 2), ("text", "#text", "a<", 4, 4, 3, 4, 3), ("text", "#text", "b<", 5, 5, 2, 5, 2), ("text", "#text", "c<", 7, 7, 1, 6, 1)]
    some = [(i, n, p, k, name, [], data, None, depth, pre, last) for i in (1, None) for k, name, data, pre, last, depth, n, p in kinds]
    nodes = spark.createDataFrame(some, S.subset(S.NODES, T.HTML_FIELDS))
    assert rows(T.to_html(nodes)) == rows(spark.createDataFrame([(i, "<style><script>a<</script>b<</style>c&lt;") for i in (1, None)], "doc_id bigint, html string"))


def test_sibling_indices(cases):
    nodes = HtmlFrame(cases).nodes()
    stored = nodes.where("kind = 'element'").select("doc_id", "node_id", "elem_idx", "elem_idx_rev", "type_idx", "type_idx_rev")
    assert rows(T.sibling_indices(nodes)) == rows(stored)


def test_selectors_on_nodes(spark):
    """The compiled plans agree with the matcher on all cases at once, a document for each."""
    docs = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(COUNTS)], "doc_id bigint, html string")
    nodes = HtmlFrame(docs).nodes().cache()
    for i, (html, selector, count) in enumerate(COUNTS):
        if any(c in selector for c in " >+~:") or i % 3 == 0:
            found = P.query_all(nodes.where(F.col("doc_id") == i), selector)
            assert found.count() == count, (html, selector)


@pytest.mark.parametrize("profile", ["observed", "spec"])
@pytest.mark.parametrize("selector", ["nav ul li a[href]", "p + p", "h1 ~ p", "li:not(ul > li:first-child) a", "a, .ad", "article > p b", "li:is(nav li):nth-child(2n)", "div:has(p), nav:has(> ul)", "p:contains('the')"])
def test_plans_equal_matcher(spark, sf, selector, profile):
    frame = HtmlFrame(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html", profile)
    joined = rows(frame.query_nodes(selector).select("doc_id", "node_id"))
    assert joined == rows(frame.query_all(selector).select("doc_id", "node_id"))
    first = rows(P.query(frame.nodes(), selector, frame.options).select("doc_id", "node_id"))
    assert first == rows(frame.query(selector).select("doc_id", "node_id"))


def test_plan_shapes(spark, sf):
    docs = spark.read.parquet(f"{sf}/pages.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    frame = HtmlFrame(docs, "page_id", "html")
    for df in (frame.to_markdown_safe(), frame.query_all("nav ul li a"), frame.nodes(), frame.query_nodes("li.a[href]:first-child"), frame.errors()):
        assert "Exchange" not in plan(df)
    assert "url" not in plan(frame.to_text()).split("ReadSchema")[1]
    assert "<nav" in plan(frame.query_all("nav ul"))


def test_fields(cases):
    frame = HtmlFrame(cases)
    assert rows(frame.nodes("doc_id", "pre", "name")) == rows(frame.nodes().select("doc_id", "name", "pre"))
    with pytest.raises(ValueError):
        frame.nodes("nope")


def test_matches_and_errors(cases):
    frame = HtmlFrame(cases)
    m = frame.matches("p")
    assert m.where("matches").count() == frame.query_nodes("p").count() and m.count() == frame.nodes().count()
    with pytest.raises(SelectorError):
        frame.query_all("[")
    assert frame.root().count() == len(HTML) + 1


def test_prefilter_is_sound(spark):
    docs = spark.createDataFrame([(0, "<DIV><P>x"), (1, "x</p>"), (2, "<image>"), (3, "div")], "doc_id bigint, html string")
    assert rows(D.select(docs, "div").select("doc_id")) == [(0,)]
    assert rows(D.select(docs, "p").select("doc_id")) == [(0,), (1,)]
    assert rows(D.select(docs, "img").select("doc_id")) == [(2,)]
    assert rows(D.select(docs, "body, div").select("doc_id")) == [(0,), (0,), (1,), (2,), (3,)]


def test_raise_fails_the_job(spark):
    docs = spark.createDataFrame([(0, "<script>x</script>")], "doc_id bigint, html string")
    with pytest.raises(PySparkException, match="Disallowed tag"):
        HtmlFrame(docs).sanitize(DEFAULT_POLICY.but(unsafe_handling="raise")).to_html().collect()
    found = HtmlFrame(docs).sanitize(DEFAULT_POLICY.but(unsafe_handling="collect")).errors()
    assert {r.code for r in found.collect()} == {"unsafe-html"}


def test_navigation(spark):
    docs = spark.createDataFrame([(1, "<div id=a><p>1</p>t<p>2<b>3</b></p></div>")], "doc_id bigint, html string")
    nodes = HtmlFrame(docs).nodes().cache()
    div, ps = nodes.where("name = 'div'"), nodes.where("name = 'p'")
    names = lambda df: [r.name for r in df.orderBy("from_id", "pre").collect()]
    assert names(T.children(nodes, div)) == ["p", "#text", "p"]
    assert names(T.descendants(nodes, div)) == ["div", "p", "#text", "#text", "p", "#text", "b", "#text"]
    assert names(T.ancestors(nodes, div)) == ["#document", "html", "body"]
    assert names(T.parent(nodes, ps)) == ["div", "div"]
    assert names(T.next_sibling(nodes, ps)) == ["#text"] and names(T.prev_sibling(nodes, ps)) == ["#text"]
    assert names(T.first_child(nodes, div)) == ["p"] and [r.last for r in T.last_child(nodes, div).collect()] == [r.last for r in div.collect()]
    assert [r.text for r in T.subtree_text(nodes, ps).orderBy("from_id").collect()] == ["1", "23"]
    assert T.node_counts(nodes).first().n_nodes == nodes.count()
    changed = T.remove_attr(T.set_attr(nodes, F.col("name") == "div", "class", "x"), F.col("name") == "div", "id")
    assert changed.where("name = 'div'").select(P.attr("class").alias("c"), P.has_attr("id").alias("i")).first() == ("x", False)
    assert T.remove(nodes, F.col("name") == "p").where("kind = 'text'").count() == 1
    assert rows(T.attributes(nodes).select("name", "attr", "value")) == [("div", "id", "a")]
    assert nodes.where(T.can_have_children()).count() == nodes.where("kind not in ('text', 'comment', 'doctype')").count()
    assert T.get(nodes, 1, 1).first().kind == "document"


def test_edits(spark):
    docs = spark.createDataFrame([(1, "<div><p>1</p><b>2</b></div><i>3</i>")], "doc_id bigint, html string")
    nodes = HtmlFrame(docs).nodes().cache()
    ids = {r.name: r.node_id for r in nodes.where("kind = 'element'").collect()}
    html = lambda n: T.to_html(n).first().html
    assert rows(T.reindex(nodes)) == rows(nodes)
    move = lambda *m: spark.createDataFrame([(1, *m)], "doc_id bigint, parent_id int, node_id int, before_id int")
    assert html(T.insert_before(nodes, move(ids["div"], ids["i"], ids["b"]))) == "<html><head></head><body><div><p>1</p><i>3</i><b>2</b></div></body></html>"
    assert html(T.append_child(nodes, move(ids["i"], ids["p"], None))) == "<html><head></head><body><div><b>2</b></div><i>3<p>1</p></i></body></html>"
    new = spark.createDataFrame([(1, 90, "element", "u", [("id", "x")], None), (1, 91, "text", None, [], "new")], f"doc_id bigint, node_id int, kind string, name string, attrs {S.ATTRS}, data string")
    both = T.append_child(T.create_nodes(nodes, new), spark.createDataFrame([(1, ids["b"], 90), (1, 90, 91)], "doc_id bigint, parent_id int, node_id int"))
    assert "<b>2<u id=\"x\">new</u></b>" in html(both)
    assert P.query_all(both, "b > u:first-child").count() == 1
    assert html(T.remove_child(nodes, F.col("name") == "div")) == "<html><head></head><body><i>3</i></body></html>"


def test_functions(spark):
    one = spark.createDataFrame([("a<b>&\"c", 60, "https://A.org:8/x?y=a b~*", "x\ny")], "s string, n int, u string, t string")
    got = one.select(
        X.html_escape("s"), X.attr_escape("s"), X.decode_numeric("n"), X.url_host("u"), X.url_proxy("u", UrlProxy("p", "q")), X.decode_entity(F.lit("nbsp")), X.decode_entity(F.lit("nope")),
        X.is_legacy_entity(F.lit("euro")), X.error_message(F.lit("eof-in-tag")), X.line_of("t", F.lit(2)), X.column_of("t", F.lit(2)), X.decode_entities(F.lit("&lt;")), X.normalize_space(F.lit("  a  b ")),
    ).first()
    assert tuple(got) == (
        "a&lt;b&gt;&amp;\"c", "a<b>&amp;&quot;c", "<", "A.org", "p?q=https%3A%2F%2FA.org%3A8%2Fx%3Fy%3Da%20b~%2A", " ", None, False, "Unexpected end of file in tag", 2, 1, "<", "a b ",
    )
    kinds = spark.createDataFrame([("br",), ("b",), ("h1",), ("x",)], "name string").select(X.is_void("name"), X.is_formatting("name"), X.is_special("name"), X.is_heading("name"))
    assert [tuple(r) for r in kinds.collect()] == [(True, False, True, False), (False, True, False, False), (False, False, True, True), (False, False, False, False)]
    rule = UrlRule(frozenset(("https",)), allowed_hosts=frozenset(("a.org",)))
    from sparkloom import UrlPolicy

    urls = ["https://A.org:8/x", "http://a.org", "/x", "#f", "", " \t", "//a.org/z", "x:y", "https:///"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(X.url_allowed("u", rule)).collect()] == [UrlPolicy().check_url(rule, u) for u in urls]


def test_sql_functions(spark):
    sparkloom.register(spark)
    assert spark.sql("select html_to_text('<p>a</p>'), html_to_markdown('<b>x</b>'), html_sanitize('<i onclick=x>y</i>'), html_count('<p><p>', 'p'), html_to_text(null)").first() == ("a", "**x**\n", "<i>y</i>", 2, None)


def test_sources_and_stream(spark, tmp_path):
    for name, body in (("a.html", "<title>A</title><p>1\n2"), ("b.html", "<p>B"), ("c.txt", "no")):
        (tmp_path / name).write_text(body)
    files = sources.read_files(spark, str(tmp_path))
    assert rows(files.select("file_name")) == [("a.html",), ("b.html",)]
    assert sources.show_text(HtmlFrame(sources.from_string(spark, "<p>x")).to_text(), "text") == "x\n"
    out = tmp_path / "out"
    sources.write_table(HtmlFrame(files).to_text(), str(out))
    assert sorted(r.text for r in spark.read.parquet(str(out)).collect()) == ["A1\n2", "B"]
    src = tmp_path / "in"
    src.mkdir()
    os.rename(tmp_path / "a.html", src / "a.html")
    stream = HtmlFrame(streaming.read_files(spark, str(src), 1)).query_all("p")
    q = streaming.write(stream, str(tmp_path / "s"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["1\n2"]


def test_command_line(spark, tmp_path, capsys):
    from sparkloom.__main__ import main

    f = tmp_path / "x.html"
    f.write_text("<p class=a>1</p><p onclick=x>2 &amp; 3</p></x>")
    assert main([str(f), "-q", "p", "-f", "text"]) == 0 and capsys.readouterr().out == "1\n2 &amp; 3\n"
    assert main([str(f), "--safe"]) == 0 and "onclick" not in capsys.readouterr().out
    assert main([str(f), "-q", "["]) == 1
    assert main([str(f), "-e", "-f", "markdown"]) == 0 and "unexpected-end-tag" in capsys.readouterr().err


def test_queries_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    for name, sql in recipes.ORACLE_SQL.items():
        got = recipes.QUERIES[name](spark, sf).toPandas()
        want = con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        text = lambda d, cols=cols: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
        assert text(got) == text(want), name


def test_summaries_are_whole(spark, tmp_path):
    long = "word " * 1000 + "end"
    page = f"<html><head><title>T</title></head><body><article><p>{long[:300]}<b>{long[300:]}</b></p><p>next</p></article></body></html>"
    spark.createDataFrame([(1, page)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in recipes.summaries(spark, str(tmp_path)).select("page_id", "title", "summary").collect()] == [(1, "T", long)]


def test_every_query_runs(spark, sf):
    for name, q in recipes.QUERIES.items():
        assert q(spark, sf).count() > 0, name


def test_spec_profile_on_nodes(spark):
    docs = spark.createDataFrame([(0, "<svg><circle/></svg><p>x")], "doc_id bigint, html string")
    spaces = {r.name: r.namespace for r in HtmlFrame(docs, profile=ParseOptions.spec()).nodes().where("kind = 'element'").collect()}
    assert spaces["circle"] == "svg" and spaces["p"] == "html"
    assert Matcher(parse("<p>")).query_all("p") and to_html(parse("<p>"))
