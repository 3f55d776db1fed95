"""Schemas of tokens, nodes, errors and matches."""

from __future__ import annotations

import pyarrow as pa

ATTRS = "array<struct<name:string,value:string>>"
DOCTYPE = "struct<name:string,public_id:string,system_id:string,force_quirks:boolean>"
TOKENS = f"doc_id bigint, tok_ord int, kind string, name string, attrs {ATTRS}, self_closing boolean, data string, doctype {DOCTYPE}"
NODES = (
    f"doc_id bigint, node_id int, parent_id int, kind string, name string, namespace string, attrs {ATTRS}, data string, doctype {DOCTYPE}, depth int, "
    "pre int, last int, sib_ord int, elem_idx int, elem_idx_rev int, type_idx int, type_idx_rev int, prev_elem_id int, parent_kind string, is_empty boolean"
)
ERRORS = "doc_id bigint, err_ord int, category string, code string, line int, col int, message string"
MATCHES = f"doc_id bigint, ord int, node_id int, name string, attrs {ATTRS}, content string"

_ATTR = pa.struct([("name", pa.string()), ("value", pa.string())])
_DOCTYPE = pa.struct([("name", pa.string()), ("public_id", pa.string()), ("system_id", pa.string()), ("force_quirks", pa.bool_())])
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), ATTRS: pa.list_(_ATTR), DOCTYPE: _DOCTYPE}


def _fields(ddl: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(tuple(part.strip().split(" ", 1)))
            part = ""
        else:
            part += c
    return out


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of one of the above."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in _fields(ddl)])


def subset(ddl: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in _fields(ddl) if name in names)


def attrs_array(rows: list) -> pa.Array:
    """A column of attribute lists, built from flat arrays."""
    at, names, values = [0], [], []
    for r in rows:
        for k, v in r:
            names.append(k)
            values.append(v)
        at.append(len(names))
    flat = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], fields=list(_ATTR))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
