"""Column functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as C
from ..html.clean import SanitizationPolicy, UrlPolicy, UrlProxy, UrlRule
from ..html.tokenizer import decode_entities as _decode
from ..html.tokenizer import decode_numeric as _numeric


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_escape(c: str | Column) -> Column:
    """Text for HTML."""
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attr_escape(c: str | Column) -> Column:
    """An attribute value for HTML, to stand in double quotes."""
    return F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def normalize_space(c: str | Column) -> Column:
    """Without leading white space, runs of it as one space."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^[{C.UNICODE_WS}]+", ""), f"[{C.UNICODE_WS}]+", " ")


def decode_entity(c: str | Column) -> Column:
    """What a known entity name (without & and ;) stands for; else null."""
    flat = [x for k, v in C.ENTITIES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*flat), _col(c))


def is_legacy_entity(c: str | Column) -> Column:
    return _col(c).isin(*C.LEGACY_ENTITIES)


@F.arrow_udf(StringType())
def decode_numeric(c: pa.Array) -> pa.Array:
    """The character of a numeric reference."""
    return pa.array([None if x is None else _numeric(x) for x in c.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decode_entities(c: pa.Array) -> pa.Array:
    """A text with its references decoded."""
    return pa.array([None if x is None else _decode(x) for x in c.to_pylist()], pa.string())


def url_host(c: str | Column) -> Column:
    """The host as written; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), "://([^/:?#]*)", 1), F.lit(""))


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_allowed(c: str | Column, rule: UrlRule, policy: UrlPolicy = UrlPolicy()) -> Column:
    """Whether a URL passes a rule."""
    u = F.regexp_replace(_col(c), f"^[{C.UNICODE_WS}]+|[{C.UNICODE_WS}]+$", "")
    relative = policy.default_allow_relative if rule.allow_relative is None else rule.allow_relative

    def absolute(url: Column) -> Column:
        ok = _fold(F.substring_index(url, ":", 1)).isin(*rule.allowed_schemes) if rule.allowed_schemes else F.lit(False)
        if rule.allowed_hosts is not None:
            ok &= F.coalesce(_fold(url_host(url)).isin(*rule.allowed_hosts), F.lit(False)) if rule.allowed_hosts else F.lit(False)
        return ok

    resolved = F.lit(False) if rule.resolve_protocol_relative is None else absolute(F.concat(F.lit(f"{rule.resolve_protocol_relative}:"), u))
    return (
        F.when(u == "", False).when(F.startswith(u, F.lit("#")), rule.allow_fragment)
        .when(F.startswith(u, F.lit("//")), resolved).when(~F.contains(u, F.lit(":")), relative).otherwise(absolute(u))
    )


def url_proxy(c: str | Column, proxy: UrlProxy) -> Column:
    """The URL as a parameter of the proxy's; percent-encoded but for unreserved characters."""
    coded = F.replace(F.replace(F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"{proxy.url}{'&' if '?' in proxy.url else '?'}{proxy.param}="), coded)


def attrs_allowed(tag: str, attrs: str | Column, policy: SanitizationPolicy) -> Column:
    """The attributes of a tag that a policy keeps, without its URL rules' proxies."""
    allowed = sorted(policy.allowed_attrs_for_tag(tag))

    def keep(a: Column) -> Column:
        ok = _fold(a["name"]).isin(*allowed) & ~F.startswith(_fold(a["name"]), F.lit("on")) if allowed else F.lit(False)
        for (t, n), rule in policy.url_policy.allow_rules.items():
            if t == tag:
                ok &= (_fold(a["name"]) != n) | a["value"].isNull() | url_allowed(a["value"], rule, policy.url_policy)
        return ok

    return F.filter(_col(attrs), keep)


def error_message(code: str | Column, tag: str | Column | None = None) -> Column:
    """The message of an error code; the code itself if there is none."""
    flat = [x for k, v in C.ERROR_MESSAGES.items() for x in (F.lit(k), F.lit(v))]
    text = F.coalesce(F.try_element_at(F.create_map(*flat), _col(code)), _col(code))
    return F.replace(text, F.lit("{}"), F.lit("unknown") if tag is None else F.coalesce(_col(tag), F.lit("unknown")))


def error_display(code: str | Column, message: str | Column, line: str | Column, col: str | Column) -> Column:
    what = F.when(_col(message) == _col(code), _col(code)).otherwise(F.concat(_col(code), F.lit(" - "), _col(message)))
    return F.when(_col(line).isNull() | _col(col).isNull(), what).otherwise(F.concat(F.lit("("), _col(line).cast("string"), F.lit(","), _col(col).cast("string"), F.lit("): "), what))


def is_void(name: str | Column) -> Column:
    return _col(name).isin(*C.VOID)


def is_formatting(name: str | Column) -> Column:
    return _col(name).isin(*C.FORMATTING)


def is_special(name: str | Column) -> Column:
    return _col(name).isin(*C.SPECIAL)


def is_heading(name: str | Column) -> Column:
    return _col(name).isin(*C.HEADINGS)


def line_of(text: str | Column, offset: str | Column) -> Column:
    """Line (from 1) of a character offset (from 0)."""
    return F.size(F.split(F.substr(_col(text), F.lit(1), _col(offset)), "\n", -1))


def column_of(text: str | Column, offset: str | Column) -> Column:
    return F.char_length(F.element_at(F.split(F.substr(_col(text), F.lit(1), _col(offset)), "\n", -1), -1)) + 1
