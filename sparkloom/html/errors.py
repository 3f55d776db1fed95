"""Errors: rows about malformed input, and exceptions."""

from __future__ import annotations

import bisect
from typing import NamedTuple

from ..constants import ERROR_MESSAGES


class SelectorError(ValueError):
    """A CSS selector that cannot be parsed."""


class UnsafeHtmlError(ValueError):
    """Markup against the policy, when the policy says raise."""

    def __str__(self) -> str:
        return f"Unsafe HTML: {self.args[0]}"


def error_message(code: str, tag: str | None = None) -> str:
    return ERROR_MESSAGES.get(code, code).replace("{}", tag or "unknown")


class ParseError(NamedTuple):
    category: str
    code: str
    line: int | None
    col: int | None
    message: str

    @classmethod
    def of(cls, code: str, at: tuple[int, int] | None = None, category: str = "parse", tag: str | None = None) -> ParseError:
        return cls(category, code, *(at or (None, None)), error_message(code, tag))

    def __str__(self) -> str:
        what = self.code if self.message == self.code else f"{self.code} - {self.message}"
        return what if self.line is None or self.col is None else f"({self.line},{self.col}): {what}"


class Positions:
    """Line and column (both from 1, in characters) of offsets of a text."""

    def __init__(self, text: str):
        self.ends = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []

    def at(self, offset: int) -> tuple[int, int]:
        k = bisect.bisect_left(self.ends, offset)
        return k + 1, offset - (self.ends[k - 1] + 1 if k else 0) + 1
