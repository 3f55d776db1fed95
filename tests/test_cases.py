"""The case queries against their stated values, and the time that large and odd documents take."""

import time

import pytest

from sparkloom import cases
from sparkloom.html.match import Matcher
from sparkloom.html.render import to_html
from sparkloom.html.tokenizer import decode_entities
from sparkloom.html.tree import parse


@pytest.mark.parametrize("name", cases.QUERIES)
def test_case_query(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "orders"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = cases.QUERIES[name](spark, sf).toPandas(), con.execute(cases.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_numeric_references_with_leading_zeros():
    assert decode_entities("&#0000000000000065;&#x000000000000041;&#99999999999999;&#0000000000000;") == "AA��"


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "a < b " * 200_000, "<ul>" + "<li>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<span>" * 50_000 + "</u>" * 1000])
def test_parsing_takes_linear_time(html):
    start = time.time()
    tree = parse(html)
    assert time.time() - start < 20
    assert len(tree.kind) > 3


@pytest.mark.parametrize("selector,count", [("li + li", 99_999), ("li ~ li", 99_999), ("h1 ~ li", 0), ("li:first-child ~ li", 99_999), ("ul > li", 100_000)])
def test_matching_takes_linear_time(selector, count):
    tree = parse("<ul>" + "<li>x</li>" * 100_000 + "</ul>")
    start = time.time()
    assert len(Matcher(tree).query_all(selector)) == count
    assert time.time() - start < 20


def test_long_text_is_whole():
    assert to_html(parse("a < b " * 1000)).count("&lt; b ") == 1000
