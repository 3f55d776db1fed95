"""Options of parsing and output."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ParseOptions:
    """Each flag turns on behaviour of the HTML standard; without any, documents parse as in the `observed` profile."""

    decode_entities: bool = False
    raw_text: bool = False
    eof_flush: bool = False
    doctype_ids: bool = False
    empty_values: bool = False
    void_elements: bool = False
    foreign_elements: bool = False
    html_at_eof: bool = False
    close_definition: bool = False
    unlink_removed: bool = False
    drop_doctype: bool = False
    backtracking: bool = False
    has_contains: bool = False
    markdown_spaces: bool = False
    css_filter: bool = False
    css_syntax: bool = False

    @classmethod
    def spec(cls) -> ParseOptions:
        return cls(**{f.name: True for f in fields(cls)})

    @classmethod
    def of(cls, profile: str | ParseOptions) -> ParseOptions:
        if isinstance(profile, ParseOptions):
            return profile
        if profile not in ("observed", "spec"):
            raise ValueError(f"unknown profile: {profile}")
        return cls.spec() if profile == "spec" else cls()

    def but(self, **flags: bool) -> ParseOptions:
        return replace(self, **flags)


@dataclass(frozen=True)
class HtmlOptions:
    include_doctype: bool = True
    pretty: bool = False
    indent: str = "  "


@dataclass(frozen=True)
class MarkdownOptions:
    atx_headers: bool = True
    bullet_char: str = "-"
    emphasis_char: str = "*"
    strong_char: str = "**"
    code_fence: str = "```"
