"""Sealed documents: what their encryption dictionary says, and streams in the clear."""

from __future__ import annotations

from typing import NamedTuple

from quire.functions import crypt
from quire.functions.strings import string_bytes
from quire.sources.objects import Atom, Stream, Value, entries, integer, name_of

#: Methods by the names that crypt filters give them.
METHODS = {"/V2": "rc4", "/AESV2": "aes", "/None": "none", "/Identity": "none"}


class Seal(NamedTuple):
    """A document's key, the method of its streams, those of its named crypt filters, and whether the password is the user's."""

    key: bytes
    default: str
    named: dict[str, str]
    fits: bool


def _raw(value: Value | None, doc) -> bytes:
    value = doc.resolve(value)
    try:
        return string_bytes(value.text) if isinstance(value, Atom) and value.kind in ("string", "hex") else b""
    except ValueError:
        return b""


def _methods(held: dict[str, Value], doc) -> tuple[str, dict[str, str], int] | None:
    """The method of streams, those of named filters, and the key's bits; None for schemes that aren't known."""
    number = lambda key, default: integer(doc.resolve(held.get(key))) or default
    version = number("/V", 0)
    if version in (1, 2):
        return "rc4", {}, number("/Length", 40) if version == 2 else 40
    if version != 4:
        return None
    named = {"/Identity": "none"}
    for name, value in entries(doc.resolve(held.get("/CF"))).items():
        method = METHODS.get(name_of(doc.resolve(entries(doc.resolve(value)).get("/CFM"))) or "/None")
        if method:
            named[name] = method
    default = named.get(name_of(doc.resolve(held.get("/StmF"))) or "/Identity")
    return (default, named, 128) if default else None


def seal(doc, password: bytes) -> Seal | None:
    """How a document is sealed; None if it isn't, or by a scheme that isn't known."""
    held = entries(doc.resolve(doc.trailer.get("/Encrypt")))
    found = _methods(held, doc) if held else None
    if found is None:
        return None
    default, named, bits = found
    ids = doc.resolve(doc.trailer.get("/ID"))
    first = _raw(ids[0], doc) if isinstance(ids, list) and ids else b""
    revision, permissions = integer(doc.resolve(held.get("/R"))) or 2, integer(doc.resolve(held.get("/P"))) or 0
    key = crypt.document_key(password, _raw(held.get("/O"), doc), permissions, first, revision, bits if 40 <= bits <= 128 else 40)
    return Seal(key, default, named, crypt.password_fits(key, _raw(held.get("/U"), doc), first, revision))


def _own_filter(stream: Stream, doc) -> str | None:
    """The crypt filter that a stream names for itself, as the first of its filters; the identity if it names none."""
    kinds = doc.resolve(stream.entries.get("/Filter"))
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if not kinds or name_of(doc.resolve(kinds[0])) != "/Crypt":
        return None
    given = doc.resolve(stream.entries.get("/DecodeParms"))
    given = doc.resolve(given[0]) if isinstance(given, list) and given else given
    return name_of(doc.resolve(entries(given).get("/Name"))) or "/Identity"


def unseal(stream: Stream, number: tuple[int, int], held: Seal, doc) -> None:
    """Puts a stream in the clear where it stands; a filter for encryption is taken off. What can't be read is left as it is.

    Cross-reference streams are never sealed. ValueError for a filter that isn't known and for damaged data."""
    if name_of(stream.entries.get("/Type")) == "/XRef":
        return
    own = _own_filter(stream, doc)
    method = held.default if own is None else held.named.get(own)
    if method is None:
        raise ValueError(f"crypt filter {own} isn't known")
    if method != "none":
        key = crypt.object_key(held.key, *number, method == "aes")
        stream.data = crypt.aes(key, stream.data) if method == "aes" else crypt.rc4(key, stream.data)
        stream.entries["/Length"] = Atom("number", str(len(stream.data)))
    if own is not None:
        for name in ("/Filter", "/DecodeParms"):
            value = doc.resolve(stream.entries.get(name))
            rest = value[1:] if isinstance(value, list) else []
            stream.entries.pop(name, None)
            if rest:
                stream.entries[name] = rest[0] if len(rest) == 1 else rest
