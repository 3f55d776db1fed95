"""Selectors to plans over the node table.

A compound is a predicate on one row of nodes, so selectors without combinators are a filter without a shuffle. A
combinator is a join on doc_id: child and adjacent joins are on node ids, descendant and sibling joins have a range
condition besides. Parts are joined from the right to the left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNICODE_WS
from ..options import ParseOptions
from .selector import Part, Selector, Simple, has_combinator, parse_nth, parse_selector

_WS = f"[{UNICODE_WS}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORM = ("input", "select", "textarea")


def attr(name: str, attrs: str | Column = "attrs") -> Column:
    """The value of an attribute; null if it is absent or has none."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def has_attr(name: str, attrs: str | Column = "attrs") -> Column:
    return F.coalesce(F.exists(attrs, lambda a: a["name"] == name), F.lit(False))


def nth(index: Column, ab: tuple[int, int] | None) -> Column:
    if ab is None:
        return F.lit(False)
    a, b = ab
    if a == 0:
        return F.coalesce(index == b, F.lit(False))
    return F.coalesce(((index - b) % a == 0) & ((index - b) / a >= 0), F.lit(False))


def _attribute(s: Simple) -> Column:
    if s.op == "has":
        return has_attr(s.name)
    value, want = attr(s.name), F.lit(s.value)
    if s.fold:
        value, want = F.translate(value, _UPPER, _LOWER), F.translate(want, _UPPER, _LOWER)
    test = {
        "exact": lambda: value == want,
        "word": lambda: F.array_contains(F.split(value, _WS), want) & (want != ""),
        "dash": lambda: (value == want) | F.startswith(value, F.concat(want, F.lit("-"))),
        "prefix": lambda: F.startswith(value, want),
        "suffix": lambda: F.endswith(value, want),
        "part": lambda: F.contains(value, want),
    }[s.op]()
    return F.coalesce(test, F.lit(False))


def _pseudo(s: Simple) -> Column:
    name, n = s.name, F.col("name")
    ones = {
        "first-child": ("elem_idx",), "last-child": ("elem_idx_rev",), "only-child": ("elem_idx", "elem_idx_rev"),
        "first-of-type": ("type_idx",), "last-of-type": ("type_idx_rev",), "only-of-type": ("type_idx", "type_idx_rev"),
    }
    if name in ones:
        return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ones[name]))
    counted = {"nth-child": "elem_idx", "nth-last-child": "elem_idx_rev", "nth-of-type": "type_idx", "nth-last-of-type": "type_idx_rev"}
    if name in counted:
        return nth(F.col(counted[name]), parse_nth(s.value))
    return {
        "empty": lambda: F.col("is_empty"),
        "root": lambda: F.coalesce(F.col("parent_kind") == "document", F.lit(False)),
        "enabled": lambda: n.isin(*_FORM, "button") & ~has_attr("disabled"),
        "disabled": lambda: has_attr("disabled"),
        "checked": lambda: has_attr("checked"),
        "required": lambda: n.isin(*_FORM) & has_attr("required"),
        "optional": lambda: n.isin(*_FORM) & ~has_attr("required"),
        "read-only": lambda: n.isin("input", "textarea") & has_attr("readonly"),
        "read-write": lambda: n.isin("input", "textarea") & ~has_attr("readonly"),
        "placeholder-shown": lambda: n.isin("input", "textarea") & has_attr("placeholder"),
    }.get(name, lambda: F.lit(False))()


class Compiler:
    """Compiles against one node table; `marks` are columns that joins have added for what is no row predicate."""

    def __init__(self, nodes: DataFrame, options: ParseOptions = ParseOptions()):
        self.nodes, self.options = nodes, options
        self.marks: dict[object, str] = {}

    def predicate(self, s: Simple) -> Column:
        if s.kind == "any":
            return F.lit(True)
        if s.kind == "tag":
            return F.translate("name", _UPPER, _LOWER) == s.name
        if s.kind == "id":
            return F.coalesce(attr("id") == s.name, F.lit(False))
        if s.kind == "class":
            return F.coalesce(F.array_contains(F.split(attr("class"), _WS), s.name), F.lit(False))
        if s.kind == "attr":
            return _attribute(s)
        if s.kind == "pseudo":
            if self.options.has_contains and s.name in ("has", "contains") and s.value:
                return self._marked(s, lambda: self._has(s.value) if s.name == "has" else self._contains(s.value))
            return _pseudo(s)
        inner = [self.node_test(x) for x in s.inner]
        found = reduce(lambda a, b: a | b, inner) if inner else F.lit(False)
        return ~found if s.kind == "not" else found

    def node_test(self, s: Selector) -> Column:
        """Whether a row is matched by a complex selector."""
        if not s:
            return F.lit(False)
        if len(s) == 1:
            return self.compound(s[0])
        return self._marked(s, lambda: self.hits(s))

    def _marked(self, key: object, find) -> Column:
        if key not in self.marks:
            found = find()  # may add marks of its own
            name = f"__m{len(self.marks)}"
            found = found.select("doc_id", "node_id").distinct().withColumn(name, F.lit(True))
            self.nodes = self.nodes.join(found, ["doc_id", "node_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
            self.marks[key] = name
        return F.col(self.marks[key])

    def compound(self, part: Part) -> Column:
        tests = [self.predicate(s) for s in part.simples]
        return reduce(lambda a, b: a & b, tests, F.col("kind") == "element")

    def hits(self, s: Selector) -> DataFrame:
        """doc_id, node_id of what a selector with combinators matches."""
        fields = ("node_id", "parent_id", "pre", "last", "sib_ord", "prev_elem_id")
        test = self.compound(s[-1])
        now = self.nodes.where(test).select("doc_id", F.col("node_id").alias("hit"), *(F.col(c).alias(f"c_{c}") for c in fields))
        for k in range(len(s) - 1, 0, -1):
            test = self.compound(s[k - 1])
            left = self.nodes.where(test).select(F.col("doc_id").alias("l_doc"), *(F.col(c).alias(f"l_{c}") for c in fields))
            on = F.col("doc_id") == F.col("l_doc")
            how = s[k].combinator
            if how == "child":
                on &= F.col("c_parent_id") == F.col("l_node_id")
            elif how == "adjacent":
                on &= F.col("c_prev_elem_id") == F.col("l_node_id")
            elif how == "descendant":
                on &= (F.col("l_pre") < F.col("c_pre")) & (F.col("c_pre") <= F.col("l_last"))
            else:
                on &= (F.col("c_parent_id") == F.col("l_parent_id")) & (F.col("l_sib_ord") < F.col("c_sib_ord"))
            both = now.join(left, on)
            row = F.struct(*(F.col(f"l_{c}").alias(c) for c in fields))
            if self.options.backtracking:
                both = both.select("doc_id", "hit", row.alias("x")).distinct()
            elif how in ("descendant", "sibling"):  # the nearest one only
                both = both.groupBy("doc_id", "hit").agg(F.max_by(row, F.col("l_pre")).alias("x"))
            else:
                both = both.select("doc_id", "hit", row.alias("x"))
            now = both.select("doc_id", "hit", *(F.col(f"x.{c}").alias(f"c_{c}") for c in fields))
        return now.select("doc_id", F.col("hit").alias("node_id"))

    def _has(self, text: str) -> DataFrame:
        inner = Compiler(self.nodes, self.options)
        found = inner.matched(text).select(F.col("doc_id").alias("f_doc"), F.col("pre").alias("f_pre"), F.col("parent_id").alias("f_parent"))
        on = F.col("doc_id") == F.col("f_doc")
        on &= (F.col("node_id") == F.col("f_parent")) if text.startswith(">") else (F.col("pre") < F.col("f_pre")) & (F.col("f_pre") <= F.col("last"))
        return self.nodes.join(found, on, "left_semi")

    def _contains(self, text: str) -> DataFrame:
        words = self.nodes.where("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("data").alias("t_data"))
        on = (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") < F.col("t_pre")) & (F.col("t_pre") <= F.col("last"))
        texts = self.nodes.where("kind = 'element'").join(words, on).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("t_pre", "t_data"))).alias("p"))
        return texts.where(F.contains(F.array_join(F.transform("p", lambda x: x["t_data"]), ""), F.lit(text)))

    def matched(self, text: str) -> DataFrame:
        tests = [self.node_test(s) for s in parse_selector(text, self.options.css_syntax)]
        return self.nodes.where(reduce(lambda a, b: a | b, tests) & (F.col("kind") == "element"))


def query_all(nodes: DataFrame, selector: str, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The rows of nodes that match; document order is (doc_id, pre). Raises SelectorError before any job runs."""
    return Compiler(nodes, options).matched(selector).select(nodes.columns)


def query(nodes: DataFrame, selector: str, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The first match of each document."""
    every = query_all(nodes, selector, options)
    return every.groupBy("doc_id").agg(F.min_by(F.struct(*every.columns), F.col("pre")).alias("x")).select("x.*")


def matches(nodes: DataFrame, selector: str, options: ParseOptions = ParseOptions(), name: str = "matches") -> DataFrame:
    """nodes with a boolean column."""
    c = Compiler(nodes, options)
    tests = [c.node_test(s) for s in parse_selector(selector, options.css_syntax)]
    return c.nodes.select(*nodes.columns, (reduce(lambda a, b: a | b, tests) & (F.col("kind") == "element")).alias(name))


_INVENTED = {"html", "head", "body", "p", "br", "img"}


def prefilter(selector: str, html: Column, css: bool = False) -> Column:
    """A condition on the source text without which no node can match, to be pushed into the scan before parsing.

    Only tags that the parser never adds by itself, outside :not and :is, give one.
    """
    conditions, low = [], F.lower(html)  # which at most lets more pass than lower-casing A-Z would
    for s in parse_selector(selector, css):
        tags = [x.name for p in s for x in p.simples if x.kind == "tag" and x.name not in _INVENTED and "�" not in x.name]
        conditions.append(reduce(lambda a, b: a & b, (F.contains(low, F.lit(f"<{t}")) for t in tags), F.lit(True)))
    return reduce(lambda a, b: a | b, conditions)


__all__ = ["Compiler", "attr", "has_attr", "has_combinator", "matches", "prefilter", "query", "query_all"]
