"""Tables of HTML names and messages."""

from __future__ import annotations

from html.entities import html5, name2codepoint


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element classes.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
FORMATTING = _names("a b big code em font i nobr s small strike strong tt u")
SPECIAL = _names(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd "
    "details dialog dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe img input keygen li link listing main marquee menu menuitem meta nav noembed "
    "noframes noscript object ol p param plaintext pre script search section select source style summary table tbody "
    "td template textarea tfoot th thead title tr track ul wbr"
)
SCOPE = _names("applet caption html table td th marquee object template")
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = _names("html table template")
IMPLIED_END = _names("dd dt li option optgroup p rb rp rt rtc")
FOSTER_TARGETS = _names("table tbody tfoot thead tr")
FOREIGN_BREAKOUT = _names(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
)
RAW_TEXT_OUTPUT = _names("script style textarea title")
BLOCK_TEXT = _names("div p h1 h2 h3 h4 h5 h6 ul ol li br hr table tr td th article section header footer nav aside main")

# White space. HTML_WS separates attributes, ASCII_WS decides about blank text, UNICODE_WS is the
# White_Space property (U+001C to U+001F do not have it).
HTML_WS = "\t\n\f "
ASCII_WS = "\t\n\f\r "
UNICODE_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

NAMESPACES = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "mathml": "http://www.w3.org/1998/Math/MathML"}

#: The named character references that are known: those of HTML 4 but three (`lang` and `rang` as in HTML 5), `apos`, and upper-case forms of six.
ENTITIES = {n: chr(c) for n, c in name2codepoint.items() if n not in ("piv", "thetasym", "upsih")} | {n: html5[f"{n};"] for n in ("lang", "rang", "apos", "AMP", "LT", "GT", "QUOT", "COPY", "REG")}
#: Those that also stand without a semicolon: all that the HTML standard lists in that form.
LEGACY_ENTITIES = frozenset(n for n in html5 if not n.endswith(";"))

# What numeric references to C1 controls and NUL stand for (code page 1252).
NUMERIC_REPLACEMENTS = {0: "\ufffd"} | {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

# The messages of error codes; {} stands for a tag name.
ERROR_MESSAGES = {
    "eof-in-doctype": "Unexpected end of file in DOCTYPE declaration",
    "eof-in-doctype-name": "Unexpected end of file while reading DOCTYPE name",
    "eof-in-doctype-public-identifier": "Unexpected end of file in DOCTYPE public identifier",
    "eof-in-doctype-system-identifier": "Unexpected end of file in DOCTYPE system identifier",
    "expected-doctype-name-but-got-right-bracket": "Expected DOCTYPE name but got >",
    "missing-whitespace-before-doctype-name": "Missing whitespace after <!DOCTYPE",
    "abrupt-doctype-public-identifier": "DOCTYPE public identifier ended abruptly",
    "abrupt-doctype-system-identifier": "DOCTYPE system identifier ended abruptly",
    "missing-quote-before-doctype-public-identifier": "Missing quote before DOCTYPE public identifier",
    "missing-quote-before-doctype-system-identifier": "Missing quote before DOCTYPE system identifier",
    "missing-doctype-public-identifier": "Missing DOCTYPE public identifier",
    "missing-doctype-system-identifier": "Missing DOCTYPE system identifier",
    "missing-whitespace-before-doctype-public-identifier": "Missing whitespace before DOCTYPE public identifier",
    "missing-whitespace-after-doctype-public-identifier": "Missing whitespace after DOCTYPE public identifier",
    "missing-whitespace-between-doctype-public-and-system-identifiers": "Missing whitespace between DOCTYPE identifiers",
    "missing-whitespace-after-doctype-name": "Missing whitespace after DOCTYPE name",
    "unexpected-character-after-doctype-public-keyword": "Unexpected character after PUBLIC keyword",
    "unexpected-character-after-doctype-system-keyword": "Unexpected character after SYSTEM keyword",
    "unexpected-character-after-doctype-public-identifier": "Unexpected character after public identifier",
    "unexpected-character-after-doctype-system-identifier": "Unexpected character after system identifier",
    "eof-in-comment": "Unexpected end of file in comment",
    "abrupt-closing-of-empty-comment": "Comment ended abruptly with -->",
    "incorrectly-closed-comment": "Comment ended with --!> instead of -->",
    "eof-in-tag": "Unexpected end of file in tag",
    "eof-before-tag-name": "Unexpected end of file before tag name",
    "empty-end-tag": "Empty end tag </> is not allowed",
    "invalid-first-character-of-tag-name": "Invalid first character of tag name",
    "unexpected-question-mark-instead-of-tag-name": "Unexpected ? instead of tag name",
    "unexpected-character-after-solidus-in-tag": "Unexpected character after / in tag",
    "duplicate-attribute": "Duplicate attribute name",
    "missing-attribute-value": "Missing attribute value",
    "unexpected-character-in-attribute-name": "Unexpected character in attribute name",
    "unexpected-character-in-unquoted-attribute-value": "Unexpected character in unquoted attribute value",
    "missing-whitespace-between-attributes": "Missing whitespace between attributes",
    "unexpected-equals-sign-before-attribute-name": "Unexpected = before attribute name",
    "eof-in-script-html-comment-like-text": "Unexpected end of file in script with HTML-like comment",
    "eof-in-script-in-script": "Unexpected end of file in nested script tag",
    "eof-in-cdata": "Unexpected end of file in CDATA section",
    "cdata-in-html-content": "CDATA section only allowed in SVG/MathML content",
    "unexpected-null-character": "Unexpected NULL character (U+0000)",
    "incorrectly-opened-comment": "Incorrectly opened comment",
    "control-character-reference": "Invalid control character in character reference",
    "illegal-codepoint-for-numeric-entity": "Invalid codepoint in numeric character reference",
    "missing-semicolon-after-character-reference": "Missing semicolon after character reference",
    "named-entity-without-semicolon": "Named entity used without semicolon",
    "noncharacter-character-reference": "Noncharacter in character reference",
    "noncharacter-in-input-stream": "Noncharacter in input stream",
    "unexpected-doctype": "Unexpected DOCTYPE declaration",
    "unknown-doctype": "Unknown DOCTYPE (expected <!DOCTYPE html>)",
    "expected-doctype-but-got-chars": "Expected DOCTYPE but got text content",
    "expected-doctype-but-got-eof": "Expected DOCTYPE but reached end of file",
    "expected-doctype-but-got-start-tag": "Expected DOCTYPE but got <{}> tag",
    "expected-doctype-but-got-end-tag": "Expected DOCTYPE but got </{}> tag",
    "unexpected-doctype-in-foreign-content": "Unexpected DOCTYPE in SVG/MathML content",
    "unexpected-start-tag": "Unexpected <{}> start tag",
    "unexpected-end-tag": "Unexpected </{}> end tag",
    "unexpected-end-tag-before-html": "Unexpected </{}> end tag before <html>",
    "unexpected-end-tag-before-head": "Unexpected </{}> end tag before <head>",
    "unexpected-end-tag-after-head": "Unexpected </{}> end tag after <head>",
    "unexpected-start-tag-ignored": "<{}> start tag ignored in current context",
    "unexpected-start-tag-implies-end-tag": "<{}> start tag implicitly closes previous element",
    "expected-closing-tag-but-got-eof": "Expected </{}> closing tag but reached end of file",
    "expected-named-closing-tag-but-got-eof": "Expected </{}> closing tag but reached end of file",
    "invalid-codepoint": "Invalid character (U+0000 NULL or U+000C FORM FEED)",
    "invalid-codepoint-before-head": "Invalid character before <head>",
    "invalid-codepoint-in-body": "Invalid character in <body>",
    "invalid-codepoint-in-table-text": "Invalid character in table text",
    "invalid-codepoint-in-select": "Invalid character in <select>",
    "invalid-codepoint-in-foreign-content": "Invalid character in SVG/MathML content",
    "foster-parenting-character": "Text content in table requires foster parenting",
    "foster-parenting-start-tag": "Start tag in table requires foster parenting",
    "unexpected-character-implies-table-voodoo": "Unexpected character in table triggers foster parenting",
    "unexpected-start-tag-implies-table-voodoo": "<{}> start tag in table triggers foster parenting",
    "unexpected-end-tag-implies-table-voodoo": "</{}> end tag in table triggers foster parenting",
    "unexpected-implied-end-tag-in-table-view": "Unexpected implied end tag while closing table",
    "eof-in-table": "Unexpected end of file in table",
    "unexpected-cell-in-table-body": "Unexpected table cell outside of table row",
    "unexpected-form-in-table": "Form element not allowed in table context",
    "unexpected-hidden-input-in-table": "Hidden input in table triggers foster parenting",
    "unexpected-hidden-input-after-head": "Unexpected hidden input after <head>",
    "unexpected-token-in-frameset": "Unexpected content in <frameset>",
    "unexpected-token-after-frameset": "Unexpected content after <frameset>",
    "unexpected-token-after-after-frameset": "Unexpected content after frameset closed",
    "unexpected-token-after-body": "Unexpected content after </body>",
    "unexpected-char-after-body": "Unexpected character after </body>",
    "unexpected-characters-in-column-group": "Text not allowed in <colgroup>",
    "unexpected-characters-in-template-column-group": "Text not allowed in template column group",
    "unexpected-start-tag-in-column-group": "<{}> start tag not allowed in <colgroup>",
    "unexpected-start-tag-in-template-column-group": "<{}> start tag not allowed in template column group",
    "unexpected-start-tag-in-template-table-context": "<{}> start tag not allowed in template table context",
    "unexpected-start-tag-in-cell-fragment": "<{}> start tag not allowed in cell fragment context",
    "unexpected-html-element-in-foreign-content": "HTML element breaks out of SVG/MathML content",
    "unexpected-end-tag-in-foreign-content": "Mismatched </{}> end tag in SVG/MathML content",
    "unexpected-end-tag-in-fragment-context": "</{}> end tag not allowed in fragment parsing context",
    "end-tag-too-early": "</{}> end tag closed early (unclosed children)",
    "adoption-agency-1.3": "Misnested tags require adoption agency algorithm",
    "non-void-html-element-start-tag-with-trailing-solidus": "<{}/> self-closing syntax on non-void element",
    "image-start-tag": "Deprecated <{}> tag (use <img> instead)",
    "unexpected-start-tag-in-select": "Unexpected <{}> start tag in <select>",
    "unexpected-end-tag-in-select": "Unexpected </{}> end tag in <select>",
    "unexpected-select-in-select": "Unexpected nested <select> in <select>",
    "unsafe-html": "Unsafe HTML detected by sanitization policy",
}

# The default sanitization policy.
DEFAULT_TAGS = _names("p br div span blockquote pre code h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot tr th td b strong i em u s sub sup small mark hr a img")
DEFAULT_ATTRIBUTES = {
    "*": _names("class id title lang dir"),
    "a": _names("href title"),
    "img": _names("src alt title width height loading decoding"),
    "th": _names("colspan rowspan"),
    "td": _names("colspan rowspan"),
}
DEFAULT_SCHEMES = _names("http https mailto tel")
DROP_CONTENT = _names("script style")
CSS_TEXT = _names(
    "background-color color font-size font-style font-weight letter-spacing line-height text-align text-decoration "
    "text-transform white-space word-break word-spacing word-wrap"
)
