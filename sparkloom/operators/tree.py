"""Navigation and edits on the node table, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NAMESPACES
from ..plans.compile import attr, has_attr


def _pairs(nodes: DataFrame, start: DataFrame, on: Column) -> DataFrame:
    """Rows of nodes related to rows of start (doc_id, node_id), which come along as from_id."""
    a = start.select("doc_id", "node_id").distinct().alias("s").join(nodes.alias("x"), ["doc_id", "node_id"])
    a = a.select(F.col("doc_id").alias("a_doc"), *(F.col(c).alias(f"a_{c}") for c in ("node_id", "parent_id", "pre", "last", "sib_ord")))
    return a.join(nodes, (F.col("a_doc") == F.col("doc_id")) & on).select(F.col("a_node_id").alias("from_id"), *nodes.columns)


def get(nodes: DataFrame, doc_id: int, node_id: int) -> DataFrame:
    return nodes.where((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id))


def children(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """In the order of sib_ord."""
    return _pairs(nodes, start, F.col("parent_id") == F.col("a_node_id"))


def descendants(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """With the node itself, in the order of pre."""
    return _pairs(nodes, start, F.col("pre").between(F.col("a_pre"), F.col("a_last")))


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """Without the node itself; the nearest has the largest pre."""
    return _pairs(nodes, start, (F.col("pre") < F.col("a_pre")) & (F.col("a_pre") <= F.col("last")))


def parent(nodes: DataFrame, start: DataFrame) -> DataFrame:
    return _pairs(nodes, start, F.col("node_id") == F.col("a_parent_id"))


def _sibling(nodes: DataFrame, start: DataFrame, step: int) -> DataFrame:
    return _pairs(nodes, start, (F.col("parent_id") == F.col("a_parent_id")) & (F.col("sib_ord") == F.col("a_sib_ord") + step))


def next_sibling(nodes: DataFrame, start: DataFrame) -> DataFrame:
    return _sibling(nodes, start, 1)


def prev_sibling(nodes: DataFrame, start: DataFrame) -> DataFrame:
    return _sibling(nodes, start, -1)


def first_child(nodes: DataFrame, start: DataFrame) -> DataFrame:
    return children(nodes, start).where("sib_ord = 1")


def last_child(nodes: DataFrame, start: DataFrame) -> DataFrame:
    every = children(nodes, start)
    return every.groupBy("doc_id", "from_id").agg(F.max_by(F.struct(*nodes.columns), F.col("sib_ord")).alias("x")).select("from_id", "x.*")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def can_have_children(kind: str = "kind") -> Column:
    return F.col(kind).isin("document", "fragment", "element")


def namespace_uri(namespace: str = "namespace") -> Column:
    return F.coalesce(*(F.when(F.col(namespace) == k, v) for k, v in NAMESPACES.items()))


def namespace_of(text: str | Column) -> Column:
    """html, svg or mathml from a name or a URI; null for others."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.when(c.isin(k, v, *(["math"] if k == "mathml" else [])), k) for k, v in NAMESPACES.items()))


def text_nodes(nodes: DataFrame) -> DataFrame:
    """Text outside script and style."""
    silent = nodes.where((F.col("kind") == "element") & F.col("name").isin("script", "style"))
    silent = silent.select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last"))
    inside = (F.col("doc_id") == F.col("s_doc")) & (F.col("s_pre") < F.col("pre")) & (F.col("pre") <= F.col("s_last"))
    return nodes.where("kind = 'text'").join(silent, inside, "left_anti")


def _joined(parts: DataFrame, keys: list[str], order: str, text: str, name: str) -> DataFrame:
    # a document is the unit that fits into a task by construction, so its pieces are collected
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(name))


def to_text(nodes: DataFrame) -> DataFrame:
    """doc_id, text of whole documents."""
    found = _joined(text_nodes(nodes), ["doc_id"], "pre", "data", "text")
    return nodes.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def subtree_text(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """doc_id, from_id, text of the subtrees of start."""
    inside = descendants(text_nodes(nodes).unionByName(nodes.join(start.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select(nodes.columns)), start)
    return _joined(inside.withColumn("data", F.when(F.col("kind") == "text", F.col("data")).otherwise("")), ["doc_id", "from_id"], "pre", "data", "text")


HTML_FIELDS = ("doc_id", "node_id", "parent_id", "kind", "name", "attrs", "data", "doctype", "depth", "pre", "last")  # of a node, for to_html


def to_html(nodes: DataFrame) -> DataFrame:
    """doc_id, html from node rows alone: opening pieces stand at pre, closing ones behind the last descendant.

    The rows are read once, dealt by document and put together a document at a time.
    """
    from .. import constants as C
    from ..functions import attr_escape
    from ..html.render import escape_text

    element, text = F.col("kind") == "element", F.col("kind") == "text"
    void, raw = F.col("name").isin(*C.VOID), F.col("name").isin(*C.RAW_TEXT_OUTPUT)
    tag = F.concat(F.lit("<"), "name", F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.coalesce(F.concat(F.lit('="'), attr_escape(a["value"]), F.lit('"')), F.lit("")))), ""), F.lit(">"))
    d = F.col("doctype")
    public = F.when(d["public_id"] != "", F.concat(F.lit(' PUBLIC "'), d["public_id"], F.lit('"')))
    system = F.when(d["system_id"] != "", F.concat(F.when(d["public_id"].isNull(), F.lit(' SYSTEM "')).otherwise(F.lit(' "')), d["system_id"], F.lit('"')))
    doctype = F.concat(F.lit("<!DOCTYPE "), F.coalesce(d["name"], F.lit("html")), F.coalesce(public, F.lit("")), F.coalesce(system, F.lit("")), F.lit(">"))
    begin = F.when(element, tag).when(text, F.col("data")).when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "data", F.lit("-->"))).when(F.col("kind") == "doctype", doctype).otherwise("")
    end = F.when(element & ~void, F.concat(F.lit("</"), "name", F.lit(">"))).otherwise("")
    role = F.when(text, "t").when(element & void, "v").when(element & raw, "r").otherwise("")

    def write(rows: list[tuple]) -> str:
        """Rows in the order of pre; what lies within a void element is not shown."""
        script, reach, pieces = {r[1] for r in rows if r[6] == "r"}, -1, []
        for _, node, up, pre, last, depth, role, begin, end in rows:
            if pre is not None and pre <= reach:
                continue
            if role == "v":
                reach = max(reach, last)
            if role == "t" and up not in script:
                begin = escape_text(begin or "")
            pieces.append((-1 if pre is None else pre, 0, 0, begin or ""))
            if end:
                pieces.append((-1 if last is None else last, 1, -(depth or 0), end))
        return "".join(p[3] for p in sorted(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        for batch in batches:
            ids, made = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and own[0][0] != row[0]:
                    ids.append(own[0][0])
                    made.append(write(own))
                    own = []
                own.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.string())], names=["doc_id", "html"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([own[0][0]], pa.int64()), pa.array([write(own)], pa.string())], names=["doc_id", "html"])

    some = nodes.select(F.col("doc_id").cast("long"), "node_id", "parent_id", "pre", "last", "depth", role.alias("role"), begin.alias("begin"), end.alias("end"))
    return some.repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, "doc_id bigint, html string")


def sibling_indices(nodes: DataFrame) -> DataFrame:
    """The index columns once more, by window functions."""
    e = nodes.where("kind = 'element'")
    up, same = Window.partitionBy("doc_id", "parent_id"), Window.partitionBy("doc_id", "parent_id", "name")
    by = lambda w, c: F.row_number().over(w.orderBy(c))
    o, r = F.col("sib_ord"), F.col("sib_ord").desc()
    return e.select("doc_id", "node_id", by(up, o).alias("elem_idx"), by(up, r).alias("elem_idx_rev"), by(same, o).alias("type_idx"), by(same, r).alias("type_idx_rev"))


def set_attr(nodes: DataFrame, where: Column, name: str, value: str | None) -> DataFrame:
    """Sets an attribute on the rows that `where` holds for; an existing one keeps its place."""
    new = F.struct(F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"))
    changed = F.when(has_attr(name), F.transform("attrs", lambda a: F.when(a["name"] == name, new).otherwise(a))).otherwise(F.concat("attrs", F.array(new)))
    return nodes.withColumn("attrs", F.when(where, changed).otherwise(F.col("attrs")))


def remove_attr(nodes: DataFrame, where: Column, name: str) -> DataFrame:
    return nodes.withColumn("attrs", F.when(where, F.filter("attrs", lambda a: a["name"] != name)).otherwise(F.col("attrs")))


def attributes(nodes: DataFrame) -> DataFrame:
    """One row an attribute: doc_id, node_id, name, attr_ord, attr, value."""
    return nodes.where("kind = 'element'").select("doc_id", "node_id", "name", F.posexplode("attrs").alias("attr_ord", "a")).select("doc_id", "node_id", "name", "attr_ord", F.col("a.name").alias("attr"), "a.value")


def remove(nodes: DataFrame, where: Column) -> DataFrame:
    """nodes without the subtrees whose root `where` holds for; pre and last keep their gaps."""
    gone = nodes.where(where).select(F.col("doc_id").alias("g_doc"), F.col("pre").alias("g_pre"), F.col("last").alias("g_last"))
    return nodes.join(gone, (F.col("doc_id") == F.col("g_doc")) & F.col("pre").between(F.col("g_pre"), F.col("g_last")), "left_anti")


def reindex(nodes: DataFrame) -> DataFrame:
    """nodes with depth, intervals and sibling columns anew from parent_id and the order of sib_ord, a document at a time."""
    from .. import schema as S
    from ..html.tree import Tree
    from .documents import node_columns

    kinds = S.arrow(S.NODES)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["parent_id"] or 0, r["sib_ord"]))
        place = {r["node_id"]: k for k, r in enumerate(sorted(rows, key=lambda r: (r["parent_id"] is not None, r["node_id"])))}
        t = Tree()
        by_place = {place[r["node_id"]]: r for r in rows}
        for k in range(len(rows)):
            r = by_place[k]
            t.add(r["kind"], -1, r["name"], [(a["name"], a["value"]) for a in r["attrs"] or ()], r["data"])
            t.namespace[k] = r["namespace"] or "html"
            if r["doctype"]:
                t.doctype[k] = tuple(r["doctype"].values())
        for r in rows:
            if r["parent_id"] in place:
                t.parent[place[r["node_id"]]] = place[r["parent_id"]]
                t.children[place[r["parent_id"]]].append(place[r["node_id"]])
        cols = node_columns(rows[0]["doc_id"], t)
        ids = {k + 1: n for n, k in place.items()}
        for c in ("node_id", "parent_id", "prev_elem_id"):
            k = kinds.get_field_index(c)
            cols[k] = [ids.get(x) for x in cols[k]]
        return pa.Table.from_arrays([S.attrs_array(c) if f.name == "attrs" else pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return nodes.groupBy("doc_id").applyInArrow(run, S.NODES)


def insert_before(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves subtrees: moves has doc_id, parent_id, node_id and before_id (a child of parent_id; null: at the end)."""
    m = moves.select("doc_id", "node_id", F.col("parent_id").alias("m_parent"), F.col("before_id").alias("m_before"))
    ref = nodes.select("doc_id", F.col("node_id").alias("m_before"), F.col("sib_ord").alias("m_sib"))
    m = m.join(ref, ["doc_id", "m_before"], "left").withColumn("m_to", F.coalesce(F.col("m_sib") * 2 - 1, F.lit(2**31 - 1)))
    moved = nodes.join(m, ["doc_id", "node_id"], "left")
    up, at = F.coalesce("m_parent", "parent_id"), F.coalesce("m_to", F.col("sib_ord") * 2)
    return reindex(moved.withColumn("parent_id", up).withColumn("sib_ord", at.cast("int")).select(nodes.columns))


def append_child(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """As insert_before, always at the end: moves has doc_id, parent_id, node_id."""
    return insert_before(nodes, moves.select("doc_id", "parent_id", "node_id", F.lit(None).cast("int").alias("before_id")))


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows (doc_id, node_id, kind, name, attrs, data) without a parent; append_child or insert_before gives them a place."""
    names = {"text": "#text", "comment": "#comment", "fragment": "#document-fragment", "doctype": "!doctype"}
    name = F.coalesce("name", *(F.when(F.col("kind") == k, v) for k, v in names.items()))
    rows = new.withColumn("name", name).withColumn("namespace", F.when(F.col("kind") == "element", "html")).withColumn("sib_ord", F.lit(1))
    return nodes.unionByName(rows, allowMissingColumns=True)


def remove_child(nodes: DataFrame, where: Column) -> DataFrame:
    """As remove, with the indices anew."""
    return reindex(remove(nodes, where))


__all__ = [n for n in dir() if not n.startswith("_")] + [attr.__name__]
