"""A cursor over a text, for tools that read constructs of their own: an offset, and lines and columns from it."""

from __future__ import annotations

from collections.abc import Callable

from .errors import Positions
from .tokenizer import lower


class Cursor:
    """Offsets count characters; lines and columns count from 1."""

    def __init__(self, text: str):
        self.text, self.offset, self._lines = text, 0, Positions(text)

    @property
    def is_empty(self) -> bool:
        return self.offset >= len(self.text)

    @property
    def remaining(self) -> str:
        return self.text[self.offset :]

    @property
    def position(self) -> tuple[int, int]:
        return self.position_at(self.offset)

    def position_at(self, offset: int) -> tuple[int, int]:
        return self._lines.at(offset)

    def peek(self, n: int = 1, skip: int = 0) -> str:
        """Up to n characters behind the next `skip`, which stay."""
        return self.text[self.offset + skip : self.offset + skip + n]

    def starts_with(self, s: str, ignore_case: bool = False) -> bool:
        """ignore_case: of ASCII letters."""
        have = self.peek(len(s))
        return lower(have) == lower(s) if ignore_case else have == s

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        self.offset += len(out)
        return out

    def take_while(self, test: Callable[[str], bool]) -> str:
        end = self.offset
        while end < len(self.text) and test(self.text[end]):
            end += 1
        return self.take(end - self.offset)

    def skip(self, s: str, ignore_case: bool = False) -> bool:
        """Goes behind s if it is next."""
        found = self.starts_with(s, ignore_case)
        if found:
            self.offset += len(s)
        return found

    def checkpoint(self) -> int:
        return self.offset

    def restore(self, checkpoint: int) -> None:
        self.offset = checkpoint
