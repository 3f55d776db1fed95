"""A fluent interface over a DataFrame of documents, and SQL functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html.clean import DEFAULT_POLICY, SanitizationPolicy
from .html.tree import parse
from .operators import documents as D
from .operators import tree as T
from .options import HtmlOptions, MarkdownOptions, ParseOptions
from .plans import compile as P


class HtmlFrame:
    """Documents with an id and HTML. Nothing runs until a result is used."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", html_col: str = "html", profile: str | ParseOptions = "observed", policy: SanitizationPolicy | None = None):
        self.df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html"))
        self.options = ParseOptions.of(profile)
        self.policy = policy

    def sanitize(self, policy: SanitizationPolicy | None = None) -> HtmlFrame:
        """The same documents, cleaned in all that follows."""
        return HtmlFrame(self.df, "doc_id", "html", self.options, policy or DEFAULT_POLICY)

    def tokens(self) -> DataFrame:
        return D.tokens(self.df, profile=self.options)

    def nodes(self, *fields: str) -> DataFrame:
        """All columns, or those that are named."""
        return D.nodes(self.df, profile=self.options, policy=self.policy, fields=fields or None)

    def errors(self) -> DataFrame:
        return D.errors(self.df, profile=self.options, policy=self.policy)

    def root(self) -> DataFrame:
        return T.roots(self.nodes())

    def _render(self, fmt: str, **options) -> DataFrame:
        return self.df.select("doc_id", D.rendered("html", fmt, self.options, self.policy, **options).alias(fmt))

    def to_html(self, options: HtmlOptions = HtmlOptions()) -> DataFrame:
        return self._render("html", html_options=options)

    def to_html_pretty(self, options: HtmlOptions = HtmlOptions()) -> DataFrame:
        return self._render("pretty", html_options=options)

    def to_markdown(self, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
        return self._render("markdown", markdown_options=options)

    def to_text(self, block: bool = False) -> DataFrame:
        return self._render("block_text" if block else "text")

    def to_html_safe(self) -> DataFrame:
        return self.sanitize().to_html()

    def to_markdown_safe(self) -> DataFrame:
        return self.sanitize().to_markdown()

    def to_text_safe(self) -> DataFrame:
        return self.sanitize().to_text()

    def tree(self) -> DataFrame:
        return self._render("tree")

    def query_all(self, selector: str, fmt: str = "text") -> DataFrame:
        """Matches with their content, in one pass without joins."""
        return D.select(self.df, selector, fmt, profile=self.options, policy=self.policy)

    def query(self, selector: str, fmt: str = "text") -> DataFrame:
        """The first match of each document."""
        return D.select(self.df, selector, fmt, first=True, profile=self.options, policy=self.policy)

    def query_nodes(self, selector: str) -> DataFrame:
        """Rows of the node table that match, by a plan of filters and joins."""
        return P.query_all(self.nodes(), selector, self.options)

    def matches(self, selector: str) -> DataFrame:
        return P.matches(self.nodes(), selector, self.options)


def parse_html(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", profile: str | ParseOptions = "observed", context: str | None = None) -> HtmlFrame:
    """context, the element a fragment is for, changes nothing: fragments parse as documents do."""
    return HtmlFrame(df, id_col, html_col, profile)


parse_fragment = parse_html


def register(spark: SparkSession) -> None:
    """html_to_text, html_to_markdown, html_normalize, html_pretty, html_sanitize and html_count in SQL."""

    def scalar(fmt: str, policy: SanitizationPolicy | None = None):
        @F.arrow_udf("string")
        def run(c: pa.Array) -> pa.Array:
            return pa.array([None if x is None else D.write(_cleaned(x, policy), 0, fmt, ParseOptions()) for x in c.to_pylist()], pa.string())

        return run

    for name, fmt, policy in (
        ("html_to_text", "text", None), ("html_to_markdown", "markdown", None), ("html_normalize", "html", None), ("html_pretty", "pretty", None), ("html_sanitize", "html", DEFAULT_POLICY),
    ):
        spark.udf.register(name, scalar(fmt, policy))

    @F.arrow_udf("int")
    def count(c: pa.Array, selectors: pa.Array) -> pa.Array:
        from .html.match import Matcher

        return pa.array([None if x is None else len(Matcher(parse(x)).query_all(s)) for x, s in zip(c.to_pylist(), selectors.to_pylist(), strict=True)], pa.int32())

    spark.udf.register("html_count", count)


def _cleaned(text: str, policy: SanitizationPolicy | None):
    from .html.clean import clean

    t = parse(text)
    return clean(t, 0, policy) if policy else t
