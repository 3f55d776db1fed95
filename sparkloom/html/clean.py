"""Allow-list policies, and trees cleaned by them."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field, replace
from urllib.parse import quote

from .. import constants as C
from ..options import ParseOptions
from .errors import ParseError, UnsafeHtmlError
from .tree import COMMENT_NODE, DOCTYPE_NODE, ELEMENT, Tree

STRIP, RAISE, COLLECT = "strip", "raise", "collect"
ALLOW, PROXY = "allow", "proxy"


@dataclass(frozen=True)
class UrlProxy:
    url: str
    param: str

    def rewrite(self, original: str) -> str:
        return f"{self.url}{'&' if '?' in self.url else '?'}{self.param}={quote(original, safe='')}"


@dataclass(frozen=True)
class UrlRule:
    allowed_schemes: frozenset[str] = frozenset()
    allow_fragment: bool = True
    resolve_protocol_relative: str | None = "https"
    allowed_hosts: frozenset[str] | None = None
    handling: str | None = None
    allow_relative: bool | None = None
    proxy: UrlProxy | None = None

    @classmethod
    def with_schemes(cls, *schemes: str) -> UrlRule:
        return cls(frozenset(schemes))


def extract_host(url: str) -> str | None:
    m = re.search(r"://([^/:?#]*)", url)
    return m[1] or None if m else None


@dataclass(frozen=True)
class UrlPolicy:
    default_handling: str = STRIP
    default_allow_relative: bool = True
    allow_rules: dict[tuple[str, str], UrlRule] = field(default_factory=dict)
    proxy: UrlProxy | None = None

    def get_rule(self, tag: str, attr: str) -> UrlRule | None:
        return self.allow_rules.get((tag.lower(), attr.lower()))

    def check_url(self, rule: UrlRule, url: str) -> bool:
        url = url.strip(C.UNICODE_WS)
        if url[:1] in ("", "#"):
            return bool(url) and rule.allow_fragment
        if url.startswith("//"):
            if rule.resolve_protocol_relative is None:
                return False
            url = f"{rule.resolve_protocol_relative}:{url}"
        elif ":" not in url:
            return self.default_allow_relative if rule.allow_relative is None else rule.allow_relative
        if _fold(url.partition(":")[0]) not in rule.allowed_schemes:
            return False
        return rule.allowed_hosts is None or _fold(extract_host(url) or "") in rule.allowed_hosts - {""}


def _fold(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


@dataclass(frozen=True)
class SanitizationPolicy:
    allowed_tags: frozenset[str] = frozenset()
    allowed_attributes: dict[str, frozenset[str]] = field(default_factory=dict)
    url_policy: UrlPolicy = UrlPolicy()
    drop_comments: bool = True
    drop_doctype: bool = True
    drop_foreign_namespaces: bool = True
    strip_disallowed_tags: bool = True
    drop_content_tags: frozenset[str] = C.DROP_CONTENT
    allowed_css_properties: frozenset[str] = frozenset()
    force_link_rel: frozenset[str] = frozenset()
    unsafe_handling: str = STRIP

    @classmethod
    def empty(cls) -> SanitizationPolicy:
        return cls()

    def but(self, **changes: object) -> SanitizationPolicy:
        return replace(self, **changes)

    def is_tag_allowed(self, tag: str) -> bool:
        return _fold(tag) in self.allowed_tags

    def allowed_attrs_for_tag(self, tag: str) -> frozenset[str]:
        none: frozenset[str] = frozenset()
        return self.allowed_attributes.get("*", none) | self.allowed_attributes.get(_fold(tag), none)

    def is_attribute_allowed(self, tag: str, attr: str) -> bool:
        return _fold(attr) in self.allowed_attrs_for_tag(tag)

    def should_drop_content(self, tag: str) -> bool:
        return _fold(tag) in self.drop_content_tags


DEFAULT_POLICY = SanitizationPolicy(
    allowed_tags=C.DEFAULT_TAGS,
    allowed_attributes=C.DEFAULT_ATTRIBUTES,
    url_policy=UrlPolicy(
        default_handling=ALLOW,
        allow_rules={("a", "href"): UrlRule(C.DEFAULT_SCHEMES), ("img", "src"): UrlRule(resolve_protocol_relative=None)},
    ),
)


class _Report:
    def __init__(self, policy: SanitizationPolicy, errors: list[ParseError] | None):
        self.how, self.errors = policy.unsafe_handling, errors

    def __call__(self, message: str) -> None:
        if self.how == RAISE:
            raise UnsafeHtmlError(message)
        if self.how == COLLECT and self.errors is not None:
            self.errors.append(ParseError.of("unsafe-html", category="security"))


def clean_attributes(tag: str, attrs: list[tuple[str, str | None]], policy: SanitizationPolicy, unsafe=lambda message: None, css: bool = False) -> list[tuple[str, str | None]]:
    allowed = policy.allowed_attrs_for_tag(tag)
    out = []
    for name, value in attrs:
        low = _fold(name)
        if low not in allowed:
            unsafe(f"Disallowed attribute '{name}' on <{tag}>")
            continue
        rule = policy.url_policy.get_rule(tag, low)
        if rule is not None and value is not None and not policy.url_policy.check_url(rule, value):
            unsafe(f"Disallowed URL in {tag}[{name}]: {value}")
            proxy = rule.proxy or policy.url_policy.proxy
            if (rule.handling or policy.url_policy.default_handling) == PROXY and proxy:
                out.append((name, proxy.rewrite(value)))
            continue
        if low.startswith("on"):
            unsafe(f"Event handler attribute '{name}' on <{tag}>")
            continue
        if css and low == "style" and policy.allowed_css_properties and value is not None:
            kept = [d.strip() for d in value.split(";") if _fold(d.partition(":")[0].strip()) in policy.allowed_css_properties]
            value = "; ".join(kept)
        out.append((name, value))
    if tag == "a" and policy.force_link_rel:
        have = next((v for k, v in out if k == "rel"), None)
        tokens = [x for x in re.split(f"[{C.UNICODE_WS}]+", have or "") if x]
        tokens += [x for x in sorted(policy.force_link_rel) if _fold(x) not in map(_fold, tokens)]
        rel = ("rel", " ".join(tokens))
        out = [rel if k == "rel" else (k, v) for k, v in out] if any(k == "rel" for k, _ in out) else [*out, rel]
    return out


def clean(tree: Tree, root: int = 0, policy: SanitizationPolicy = DEFAULT_POLICY, options: ParseOptions = ParseOptions(), errors: list[ParseError] | None = None) -> Tree:
    """A cleaned copy. Removed nodes stay with empty name and text, or go entirely with unlink_removed."""
    t = copy.copy(tree)
    t.name, t.attrs, t.data, t.parent, t.children = tree.name[:], tree.attrs[:], tree.data[:], tree.parent[:], [c[:] for c in tree.children]
    unsafe = _Report(policy, errors)
    unwrap, gone = set(), set()
    todo, seen = [root], []

    def erase(i: int) -> None:
        gone.add(i)
        for j in t.walk(i):
            if t.kind[j] == ELEMENT:
                t.name[j], t.attrs[j] = "", []
            elif t.data[j] is not None:
                t.data[j] = ""

    while todo:
        i = todo.pop()
        seen.append(i)
        kind = t.kind[i]
        if kind == DOCTYPE_NODE and policy.drop_doctype:
            unsafe("DOCTYPE not allowed")
            if options.drop_doctype:
                gone.add(i)
        elif kind == COMMENT_NODE and policy.drop_comments:
            erase(i)
        elif kind == ELEMENT:
            tag = _fold(t.name[i])
            if policy.drop_foreign_namespaces and t.namespace.get(i, "html") != "html":
                unsafe(f"Foreign namespace element: {tag}")
                erase(i)
                continue
            if not policy.is_tag_allowed(tag):
                unsafe(f"Disallowed tag: {tag}")
                if policy.should_drop_content(tag) or not policy.strip_disallowed_tags:
                    erase(i)
                    continue
                unwrap.add(i)
            else:
                t.attrs[i] = clean_attributes(tag, t.attrs[i], policy, unsafe, options.css_filter)
        todo.extend(reversed(t.children[i]))
    drop = gone if options.unlink_removed or options.drop_doctype else set()
    if not options.unlink_removed:
        drop = {i for i in drop if t.kind[i] == DOCTYPE_NODE}
    for i in reversed(seen):  # children first
        kids = []
        for c in t.children[i]:
            if c in unwrap:
                kids += t.children[c]
            elif c not in drop:
                kids.append(c)
        t.children[i] = kids
    for i in seen:
        if i not in unwrap:
            for c in t.children[i]:
                t.parent[c] = i
    for i in unwrap:
        t.children[i] = [] if t.parent[i] >= 0 else t.children[i]
        if t.parent[i] >= 0:
            t.name[i], t.attrs[i] = "", []
    return t
