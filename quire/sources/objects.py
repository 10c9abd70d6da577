"""Values of a document as the parser makes them and the writer takes them."""

from __future__ import annotations

from typing import NamedTuple

from quire.functions.strings import name_encode, number_text


class Ref(NamedTuple):
    """A reference to an indirect object."""

    objnum: int
    gennum: int


class Atom(NamedTuple):
    """A scalar by its lexeme; names are held decoded."""

    kind: str  # name, string, hex, number, bool, null, keyword
    text: str

    def written(self) -> str:
        return name_encode(self.text) if self.kind == "name" else self.text


class Stream:
    """A dictionary with bytes behind it."""

    def __init__(self, entries: dict[str, object], data: bytes):
        self.entries, self.data = entries, data


Value = Atom | Ref | list | dict | Stream
NULL = Atom("null", "null")


def name(text: str) -> Atom:
    return Atom("name", text if text[:1] == "/" else "/" + text)


def number(x: int | float) -> Atom:
    return Atom("number", number_text(x) if isinstance(x, float) else str(x))


def entries(value: object) -> dict[str, object]:
    """The dictionary of a dictionary or stream; empty for others."""
    return value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}


def name_of(value: object) -> str | None:
    return value.text if isinstance(value, Atom) and value.kind == "name" else None


def integer(value: object) -> int | None:
    try:
        return int(value.text) if isinstance(value, Atom) else None
    except ValueError:
        return None


def real(value: object) -> float | None:
    try:
        return float(value.text) if isinstance(value, Atom) else None
    except ValueError:
        return None
