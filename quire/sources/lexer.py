"""PDF tokens with their places."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from quire.functions.strings import line_and_column

# Blanks end a token and mean nothing else; delimiters end a token and begin another. Outside strings a backslash is an
# ordinary character, and one ahead of a delimiter takes it into its word.
_BLANK, _DELIMITER = r"\x00\t\n\f\r ", r"()<>\[\]{}/%"
_PLAIN = rf"[^{_BLANK}{_DELIMITER}\\]"
_KINDS = {
    "comment": r"%[^\r\n]*",
    "name": rf"/[^{_BLANK}{_DELIMITER}]*",
    "string": r"\(",
    "mark": r"<<|>>",
    "hex": rf"<[0-9A-Fa-f{_BLANK}]*>",
    "word": rf"(?:{_PLAIN}|\\[^{_BLANK}])+",
    "other": rf"[^{_BLANK}]",
}
_TOKEN = re.compile(rf"[{_BLANK}]*(?:" + "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items()) + ")", re.S)
_PAREN = re.compile(r"\\.|[()]", re.S)


class Token(NamedTuple):
    start: int
    end: int
    text: str
    kind: str  # word, name, hex, string, mark, comment, other


class Problem(NamedTuple):
    level: str
    message: str
    line: int
    column: int


class PdfSyntaxError(ValueError):
    """Text that can't be read as a document."""


class Lexer:
    """A cursor over Latin-1 text."""

    def __init__(self, text: str, at: int = 0, comments: bool = False):
        self.text, self.at, self.comments = text, at, comments
        self.problems: list[Problem] = []

    def note(self, level: str, message: str, at: int | None = None) -> None:
        found = Problem(level, message, *line_and_column(self.text, self.at if at is None else at))
        if found not in self.problems:
            self.problems.append(found)

    def fail(self, message: str, at: int | None = None) -> None:
        line, column = line_and_column(self.text, self.at if at is None else at)
        raise PdfSyntaxError(f"{message} (line {line}, column {column})")

    def _string_end(self, start: int) -> int:
        """Behind the parenthesis that closes the one at `start`; an open string ends at its first closing one."""
        depth, first = 0, -1
        for m in _PAREN.finditer(self.text, start):
            if m[0] == "(":
                depth += 1
            elif m[0] == ")":
                depth -= 1
                if first < 0:
                    first = m.end()
                if not depth:
                    return m.end()
        if first < 0:
            self.fail("Unterminated literal string", start)
        self.note("error", "Unterminated literal string", start)
        return first

    def peek(self) -> Token | None:
        at = self.at
        token = self.next()
        self.at = at
        return token

    def next(self) -> Token | None:
        """The next token, or None at the end."""
        while m := _TOKEN.match(self.text, self.at):
            kind = m.lastgroup
            start, end = m.span(kind)
            if kind == "string":
                end = self._string_end(start)
            self.at = end
            if kind != "comment" or self.comments:
                return Token(start, end, self.text[start:end], kind)
        self.at = len(self.text)
        return None

    def __iter__(self) -> Iterator[Token]:
        while (token := self.next()) is not None:
            yield token


def tokens(text: str, comments: bool = False) -> list[Token]:
    return list(Lexer(text, 0, comments))
