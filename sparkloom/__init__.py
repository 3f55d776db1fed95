"""A Spark-native engine for HTML documents."""

from .api import HtmlFrame, parse_fragment, parse_html, register
from .html.clean import DEFAULT_POLICY, SanitizationPolicy, UrlPolicy, UrlProxy, UrlRule
from .html.errors import ParseError, SelectorError, UnsafeHtmlError
from .options import HtmlOptions, MarkdownOptions, ParseOptions

__all__ = [
    "DEFAULT_POLICY", "HtmlFrame", "HtmlOptions", "MarkdownOptions", "ParseError", "ParseOptions", "SanitizationPolicy", "SelectorError", "UnsafeHtmlError",
    "UrlPolicy", "UrlProxy", "UrlRule", "parse_fragment", "parse_html", "register",
]
