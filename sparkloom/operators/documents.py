"""Operators that read each document once: one Python pass a document, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..constants import RAW_TEXT_OUTPUT
from ..html.clean import DEFAULT_POLICY, SanitizationPolicy, clean
from ..html.errors import ParseError
from ..html.match import Matcher, is_empty
from ..html.render import dump, to_html, to_markdown, to_text
from ..html.tokenizer import DOCTYPE, RCDATA, tokenize
from ..html.tree import DOCTYPE_NODE, ELEMENT, Tree, parse, places
from ..options import HtmlOptions, MarkdownOptions, ParseOptions
from ..plans.compile import prefilter
from ..plans.selector import parse_selector

BATCH = 256  # documents that are expanded into one batch of rows


def spread(df: DataFrame) -> DataFrame:
    """Deals documents to all cores if the table comes in fewer pieces, as one of few row groups does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _expand(df: DataFrame, id_col: str, html_col: str, ddl: str, rows_of: Callable[[int, str], list[Iterable]]) -> DataFrame:
    """Rows of each document; rows_of gives the columns of one."""
    kinds = S.arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in (0, 1))
            for k in range(0, len(ids), BATCH):
                cols: list[list] = [[] for _ in kinds]
                for i, t in zip(ids[k : k + BATCH], texts[k : k + BATCH], strict=True):
                    for c, more in zip(cols, rows_of(i, t), strict=True):
                        c.extend(more)
                yield pa.RecordBatch.from_arrays([S.attrs_array(c) if f.name == "attrs" else pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return df.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, ddl)


def tokens(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", profile: str | ParseOptions = "observed") -> DataFrame:
    """The token stream, one row a token."""
    options = ParseOptions.of(profile)

    def rows(i: int, html: str) -> list[list]:
        ts = list(tokenize(html, options))
        doctype = [{"name": t.name, "public_id": t.public_id, "system_id": t.system_id, "force_quirks": t.force_quirks} if t.kind == DOCTYPE else None for t in ts]
        return [[i] * len(ts), range(len(ts)), [t.kind for t in ts], [t.name for t in ts], [t.attrs for t in ts], [t.self_closing for t in ts], [t.data for t in ts], doctype]

    return _expand(df, id_col, html_col, S.TOKENS, rows)


def _doctype(t: Tree, n: int) -> dict | None:
    if t.kind[n] != DOCTYPE_NODE:
        return None
    return dict(zip(("name", "public_id", "system_id", "force_quirks"), t.doctype[n], strict=True))


_PLACES = {"depth": "depth", "pre": "pre", "last": "last", "sib_ord": "sib", "elem_idx": "elem", "elem_idx_rev": "elem_rev", "type_idx": "same", "type_idx_rev": "same_rev", "prev_elem_id": "prev"}
_COLUMNS: dict[str, Callable[[int, Tree, list[int]], Iterable]] = {
    "doc_id": lambda i, t, o: [i] * len(o),
    "node_id": lambda i, t, o: [n + 1 for n in o],
    "parent_id": lambda i, t, o: [t.parent[n] + 1 or None for n in o],
    "kind": lambda i, t, o: [t.kind[n] for n in o],
    "name": lambda i, t, o: [t.name[n] for n in o],
    "namespace": lambda i, t, o: [t.namespace.get(n, "html") if t.kind[n] == ELEMENT else None for n in o],
    "attrs": lambda i, t, o: [t.attrs[n] for n in o],
    "data": lambda i, t, o: [t.data[n] for n in o],
    "doctype": lambda i, t, o: [_doctype(t, n) for n in o],
    "parent_kind": lambda i, t, o: [t.kind[t.parent[n]] if t.parent[n] >= 0 else None for n in o],
    "is_empty": lambda i, t, o: [is_empty(t, n) if t.kind[n] == ELEMENT else None for n in o],
}
NODE_FIELDS = tuple(f.name for f in S.arrow(S.NODES))


def node_columns(i: int, t: Tree, fields: Sequence[str] = NODE_FIELDS) -> list[Iterable]:
    """The columns of a tree's node rows, in document order."""
    at = places(t) if any(f in _PLACES for f in fields) else None
    order = at.order if at else t.walk()
    return [[getattr(at, _PLACES[f])[n] for n in order] if f in _PLACES else _COLUMNS[f](i, t, order) for f in fields]


def nodes(
    df: DataFrame, id_col: str = "doc_id", html_col: str = "html", profile: str | ParseOptions = "observed", policy: SanitizationPolicy | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    """The node table, in document order within each document; cleaned if there is a policy.

    Spark cannot prune what a Python pass returns; `fields` names the columns that are wanted, so that only they are
    computed and sent.
    """
    options = ParseOptions.of(profile)
    wanted = NODE_FIELDS if fields is None else tuple(f for f in NODE_FIELDS if f in fields)
    if fields is not None and len(wanted) != len(set(fields)):
        raise ValueError(f"unknown fields: {sorted(set(fields) - set(wanted))}")

    def rows(i: int, html: str) -> list[Iterable]:
        t = parse(html, options)
        return node_columns(i, clean(t, 0, policy, options) if policy else t, wanted)

    return _expand(df, id_col, html_col, S.subset(S.NODES, wanted), rows)


def errors(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", profile: str | ParseOptions = "observed", policy: SanitizationPolicy | None = None) -> DataFrame:
    """Parse errors, those of the tree before those of the tokens; with a policy that collects, its findings instead."""
    options = ParseOptions.of(profile)

    def rows(i: int, html: str) -> list[list]:
        found: list[ParseError] = []
        if policy:
            clean(parse(html, options), 0, policy, options, found)
        else:
            parse(html, options, found)
        return [[i] * len(found), range(len(found)), *([e[k] for e in found] for k in range(5))]

    return _expand(df, id_col, html_col, S.ERRORS, rows)


FORMATS = ("html", "pretty", "markdown", "text", "block_text", "tree")


def write(t: Tree, root: int, fmt: str, options: ParseOptions, html: HtmlOptions = HtmlOptions(), markdown: MarkdownOptions = MarkdownOptions()) -> str:
    raw = RAW_TEXT_OUTPUT - RCDATA if options.raw_text else RAW_TEXT_OUTPUT  # references in them were decoded
    return {
        "html": lambda: to_html(t, root, html, raw),
        "pretty": lambda: to_html(t, root, HtmlOptions(html.include_doctype, True, html.indent), raw),
        "markdown": lambda: to_markdown(t, root, markdown, options),
        "text": lambda: to_text(t, root),
        "block_text": lambda: to_text(t, root, "block"),
        "tree": lambda: dump(t, root),
    }[fmt]()


def rendered(
    html: str | Column, fmt: str = "html", profile: str | ParseOptions = "observed", policy: SanitizationPolicy | None = None,
    html_options: HtmlOptions = HtmlOptions(), markdown_options: MarkdownOptions = MarkdownOptions(),
) -> Column:
    """The document of an HTML column in another form, parsed, cleaned and written in one pass; null stays null."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    options = ParseOptions.of(profile)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                if text is None:
                    out.append(None)
                    continue
                t = parse(text, options)
                out.append(write(clean(t, 0, policy, options) if policy else t, 0, fmt, options, html_options, markdown_options))
            yield pa.array(out, pa.string())

    return run(F.col(html) if isinstance(html, str) else html)


def render(df: DataFrame, fmt: str = "html", html_col: str = "html", name: str | None = None, safe: bool = False, **options) -> DataFrame:
    """df with the document in another form; safe cleans it by the default policy."""
    if safe:
        options.setdefault("policy", DEFAULT_POLICY)
    return df.withColumn(name or fmt, rendered(html_col, fmt, **options))


def select(
    df: DataFrame, selector: str, fmt: str = "text", id_col: str = "doc_id", html_col: str = "html", first: bool = False,
    profile: str | ParseOptions = "observed", policy: SanitizationPolicy | None = None, skip: bool = True,
) -> DataFrame:
    """Matches of a selector with their content, in one pass: doc_id, ord, node_id, name, attrs, content.

    With skip, documents whose source cannot hold a match are filtered out before they reach Python. A policy cleans
    each match by itself, as part of its own document.
    """
    options = ParseOptions.of(profile)
    parse_selector(selector, options.css_syntax)
    if skip and not options.foreign_elements:
        df = df.where(prefilter(selector, F.col(html_col), options.css_syntax))

    def rows(i: int, html: str) -> list[list]:
        t = parse(html, options)
        found = Matcher(t, options).query_all(selector, first=first)
        content = [write(clean(t, n, policy, options) if policy else t, n, fmt, options) for n in found]
        return [[i] * len(found), range(len(found)), [n + 1 for n in found], [t.name[n] for n in found], [t.attrs[n] for n in found], content]

    return _expand(df, id_col, html_col, S.MATCHES, rows)


def count_matches(html: str | Column, selectors: list[str], profile: str | ParseOptions = "observed") -> Column:
    """Array of the match counts of several selectors over one parse of each document."""
    options = ParseOptions.of(profile)
    for s in selectors:
        parse_selector(s, options.css_syntax)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                m = Matcher(parse(text, options), options)
                out.append([len(m.query_all(s)) for s in selectors])
            yield pa.array(out, pa.list_(pa.int32()))

    return run(F.col(html) if isinstance(html, str) else html)


def match_count(html: str | Column, selector: str | Column, profile: str | ParseOptions = "observed") -> Column:
    """The number of matches of the selector beside each document; null for a null."""
    options = ParseOptions.of(profile)

    @F.arrow_udf("int")
    def run(html: pa.Array, selectors: pa.Array) -> pa.Array:
        found = ((x, s) for x, s in zip(html.to_pylist(), selectors.to_pylist(), strict=True))
        return pa.array([None if x is None or s is None else len(Matcher(parse(x, options), options).query_all(s)) for x, s in found], pa.int32())

    return run(*(F.col(c) if isinstance(c, str) else c for c in (html, selector)))
