"""PDF strings and names, as plain functions and as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# The characters of PDFDocEncoding that differ from Latin-1, from code 0x18 and from code 0x80 on
LOW_MARKS = "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc"
HIGH_MARKS = "\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e"

BLANKS = "\x00 \t\f\n\r"
DELIMITERS = "()<>{}[]/%"
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))|\\$", re.S)


def _doc_encoding() -> tuple[dict[int, str], dict[str, int]]:
    plain = [*range(0x20, 0x7F), *(c for c in range(0xA1, 0x100) if c != 0xAD), 0x09, 0x0A, 0x0D]
    codes = {c: chr(c) for c in plain}
    codes |= {0x18 + i: c for i, c in enumerate(LOW_MARKS)} | {0x80 + i: c for i, c in enumerate(HIGH_MARKS)} | {0xA0: "\u20ac"}
    back = {c: b for b, c in codes.items()}
    for c in range(0x18):  # read, never written
        codes.setdefault(c, chr(c))
    return codes, back


DOC_DECODE, DOC_ENCODE = _doc_encoding()


def doc_decode(raw: bytes) -> str:
    """PDFDocEncoding to text; ValueError for the three codes it leaves open."""
    try:
        return "".join([DOC_DECODE[b] for b in raw])
    except KeyError as e:
        raise ValueError(f"no character has code {e.args[0]:#04x} in PDFDocEncoding") from None


def doc_encode(text: str) -> bytes:
    try:
        return bytes([DOC_ENCODE[c] for c in text])
    except KeyError as e:
        raise ValueError(f"{e.args[0]!r} is not in PDFDocEncoding") from None


def literal_bytes(lexeme: str) -> bytes:
    """What a literal string (...) stands for: escapes, octal codes, continued lines."""

    def one(m: re.Match) -> str:
        octal, newline, other = m.groups()
        if octal:
            return chr(int(octal, 8) & 0xFF)
        return "" if newline or other is None else _SIMPLE.get(other, other)

    return _ESCAPE.sub(one, lexeme[1:-1]).encode("latin-1")


def hex_bytes(lexeme: str) -> bytes:
    """What a hex string <...> stands for; a missing last digit is 0."""
    digits = re.sub(f"[{re.escape(BLANKS)}\v]", "", lexeme[1:-1])
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def string_bytes(lexeme: str) -> bytes:
    if lexeme[:1] == "(" and lexeme[-1:] == ")" and len(lexeme) > 1:
        return literal_bytes(lexeme)
    if lexeme[:1] == "<" and lexeme[-1:] == ">" and len(lexeme) > 1:
        return hex_bytes(lexeme)
    raise ValueError(f"not a PDF string: {lexeme[:26]!r}")


def string_text(lexeme: str) -> str:
    raw = string_bytes(lexeme)
    return raw[2:].decode("utf-16-be") if raw[:2] == b"\xfe\xff" else doc_decode(raw)


def encode_bytes(raw: bytes, mode: str = "auto") -> str:
    """A string lexeme for bytes: literal, hex, or in auto mode hex where as many characters need an escape as there are bytes."""
    if mode not in ("auto", "literal", "hex"):
        raise ValueError(f"unknown mode {mode!r}")
    escapes = sum(raw.count(c) for c in (b"(", b")", b"\\"))
    if mode == "hex" or mode == "auto" and escapes >= len(raw):
        return f"<{raw.hex().upper()}>"
    return "(" + re.sub(r"([()\\])", r"\\\1", raw.decode("latin-1")) + ")"


def encode_text(text: str, text_mode: str = "auto", mode: str = "auto") -> str:
    """A string lexeme for text: PDFDocEncoding where it has all characters and can't be taken for UTF-16, else UTF-16BE behind a mark."""
    if text_mode not in ("auto", "pdfdocencoding", "utf16"):
        raise ValueError(f"unknown encoding {text_mode!r}")
    if text_mode != "utf16":
        try:
            raw = doc_encode(text)
            if raw[:2] != b"\xfe\xff":
                return encode_bytes(raw, mode)
            if text_mode == "pdfdocencoding":
                raise ValueError("the text would be read as UTF-16")
        except ValueError:
            if text_mode == "pdfdocencoding":
                raise
    return encode_bytes(b"\xfe\xff" + text.encode("utf-16-be"), "hex" if mode == "auto" else mode)


def encode_any(value: str | bytes) -> str:
    return encode_text(value) if isinstance(value, str) else encode_bytes(value)


def name_encode(name: str) -> str:
    """A name as written: blanks and delimiters behind the first slash become #HH; # itself stays."""
    return name[:1] + "".join(f"#{ord(c):02X}" if c in BLANKS or c in DELIMITERS else c for c in name[1:])


def name_decode(written: str) -> str:
    return re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), written)


def line_and_column(text: str, at: int) -> tuple[int, int]:
    """1-based place of an offset; CR, LF and CRLF each end a line."""
    ahead = text[:at]
    return len(re.findall("\r\n|\r|\n", ahead)) + 1, at - max(ahead.rfind("\n"), ahead.rfind("\r"))


def quoted(text: str, most: int = 26) -> str:
    """A token in a message, cut if it is long."""
    return repr(text) if len(text) <= most else repr(text[:most]) + " ..."


def number_text(x: float) -> str:
    """At most nine decimals, no exponent, no trailing zeros."""
    return f"{x + 0.0:.9f}".rstrip("0").rstrip(".")


# --- columns ---


def literal_column(text: Column) -> Column:
    """Latin-1 text as a literal string lexeme."""
    return F.concat(F.lit("("), F.regexp_replace(text, r"([()\\])", r"\\$1"), F.lit(")"))


def utf16_hex_column(text: Column) -> Column:
    return F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">"))


def hex_column(lexeme: Column) -> Column:
    """Bytes of a hex string; unhex would pad on the left, so the digit is added on the right first."""
    digits = F.regexp_replace(F.substring(lexeme, 2, 2**31 - 1), "[\\x00\\s>]", "")
    return F.unhex(F.concat(digits, F.repeat(F.lit("0"), (F.length(digits) % 2).cast("int"))))


#: Characters of PDFDocEncoding that differ from Latin-1, and the codes that they have there.
_MARKS = LOW_MARKS + HIGH_MARKS + "\u20ac"
_CODES = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))


def _wide(raw: Column) -> Column:
    return F.substring(F.hex(raw), 1, 4) == "FEFF"


def doc_text_problem(raw: Column) -> Column:
    """Why string bytes are no text: half a character, or a code that PDFDocEncoding leaves open; null where they are text."""
    half = F.when(F.octet_length(raw) % 2 == 1, "half a character")
    return F.when(_wide(raw), half).otherwise(F.when(F.decode(raw, "ISO-8859-1").rlike("[\x7f\x9f\xad]"), "a code without a character"))


def doc_text_column(raw: Column) -> Column:
    """Text of string bytes: UTF-16BE behind its mark, else PDFDocEncoding; null where string_text() raises, see doc_text_problem().

    Surrogates without a partner end the query, as Spark's decode does; text_udf reads those documents' strings one by one."""
    good = doc_text_problem(raw).isNull()
    # decode is strict, so the branch not taken must not see bytes that it can't read
    wide = F.when(_wide(raw) & good, raw).otherwise(F.unhex(F.lit("FEFF")))
    plain = F.translate(F.decode(raw, "ISO-8859-1"), _CODES, _MARKS)
    return F.when(good, F.when(_wide(raw), F.decode(F.substring(wide, 3, 2**31 - 1), "UTF-16BE")).otherwise(plain))


def text_column(text: Column) -> Column:
    """A string lexeme for text, as encode_text() chooses it: PDFDocEncoding where it has all characters and can't be taken for
    UTF-16, in hex if as many characters need an escape as there are; else UTF-16BE in hex."""
    fits = ~text.rlike("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u00ff" + _MARKS + "]") & ~text.startswith("\u00fe\u00ff")
    coded = F.translate(text, _MARKS, _CODES)
    escapes = F.length(text) - F.length(F.translate(text, "()\\", ""))
    literal = F.when(escapes >= F.length(text), F.concat(F.lit("<"), F.hex(F.encode(F.when(fits, coded).otherwise(""), "ISO-8859-1")), F.lit(">"))).otherwise(literal_column(coded))
    return F.when(fits, literal).otherwise(utf16_hex_column(text))


def name_column(name: Column) -> Column:
    """Names with blanks and delimiters escaped."""
    escaped = F.substring(name, 2, 2**31 - 1)
    for c in BLANKS + DELIMITERS:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"#{ord(c):02X}"))
    return F.concat(F.substring(name, 1, 1), escaped)


def number_column(x: Column) -> Column:
    return F.rtrim(F.rtrim(F.format_string("%.9f", x), F.lit("0")), F.lit("."))


def line_column(text: Column, at: Column) -> Column:
    return F.regexp_count(F.substr(text, F.lit(1), at), F.lit("\r\n|\r|\n")) + 1


def column_column(text: Column, at: Column) -> Column:
    """1-based column of an offset within its line; with line_column() the same as line_and_column()."""
    ahead = F.substr(text, F.lit(1), at)
    back = F.instr(F.reverse(F.translate(ahead, "\r", "\n")), "\n")  # places from the last line end on
    return F.when(back > 0, back).otherwise(F.length(ahead) + 1)


def big_endian(raw: Column) -> Column:
    """Unsigned big-endian number of up to seven bytes; none for no bytes."""
    return F.when(F.length(raw) > 0, F.conv(F.hex(raw), 16, 10).cast("long"))


@F.pandas_udf(BinaryType())
def literal_bytes_udf(lexemes: pd.Series) -> pd.Series:
    return lexemes.map(lambda s: None if s is None else string_bytes(s))


@F.pandas_udf(StringType())
def text_udf(lexemes: pd.Series) -> pd.Series:
    return lexemes.map(lambda s: None if s is None else string_text(s))


@F.pandas_udf(StringType())
def name_decode_udf(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else name_decode(s))
