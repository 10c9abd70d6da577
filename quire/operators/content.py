"""Content streams: operators with their operands, and what they leave in the graphics state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import string_bytes, string_text
from quire.sources.lexer import Lexer
from quire.sources.pdf import rows_of

# The format's operators by what they do, and how many operands each takes
GROUPS = {
    "state": {"q": 0, "Q": 0, "cm": 6, "w": 1, "J": 1, "j": 1, "M": 1, "d": 2, "ri": 1, "i": 1, "gs": 1},
    "path": {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "h": 0, "re": 4},
    "paint": {"S": 0, "s": 0, "f": 0, "F": 0, "f*": 0, "B": 0, "B*": 0, "b": 0, "b*": 0, "n": 0},
    "clip": {"W": 0, "W*": 0},
    "colour": {"G": 1, "g": 1, "RG": 3, "rg": 3, "K": 4, "k": 4},
    "text": {"BT": 0, "ET": 0, "Tc": 1, "Tw": 1, "Tz": 1, "TL": 1, "Tf": 2, "Ts": 1, "Td": 2, "Tm": 6, "T*": 0, "Tj": 1, "TJ": 1, "'": 1, '"': 3},
    "xobject": {"Do": 1},
}
COUNTS = {op: n for held in GROUPS.values() for op, n in held.items()}
OPS = "doc_id string, ord int, op string, operands array<string>, shown string, fits boolean"
Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def parse_operators(data: bytes) -> Iterator[tuple[int, str, list[str], str | None]]:
    """(ord, op, operands, shown text). Arrays are one operand; an unknown word stays among the operands of the next operator."""
    stack: list[str] = []
    inside: list[str] | None = None
    n = 0
    for t in Lexer(data.decode("latin-1")):
        if inside is not None:
            if t.text == "]":
                stack.append("[" + " ".join(inside) + "]")
                inside = None
            else:
                inside.append(t.text)
        elif t.text == "[":
            inside = []
        elif t.kind == "word" and t.text in COUNTS:
            yield n, t.text, stack, shown(t.text, stack)
            n, stack = n + 1, []
        else:
            stack.append(t.text)


def shown(op: str, operands: list[str]) -> str | None:
    """The text that an operator shows; kerning between parts is left out."""
    if op not in ("Tj", "'", '"', "TJ") or not operands:
        return None
    parts = [t.text for t in Lexer(operands[-1][1:-1])] if op == "TJ" else [operands[-1]]
    out = []
    for p in parts:
        if p[:1] in "(<":
            try:
                out.append(string_text(p))
            except ValueError:
                out.append("")
    return "".join(out)


def fits(op: str, operands: list[str]) -> bool:
    """Whether an operator has as many operands as it takes; more are left over from words that aren't known."""
    return len(operands) == COUNTS[op]


def operators(content: DataFrame) -> DataFrame:
    """Operators of content streams (doc_id, content), in order; a stream that can't be read ends there.

    Null and empty streams have none; rows of one id are read each for itself.
    """

    def make(key: str, data: bytes) -> Iterator[tuple]:
        try:
            for n, op, operands, text in parse_operators(data or b""):
                yield key, n, op, operands, text, fits(op, operands)
        except ValueError:
            return

    return rows_of(content, OPS, make)


def operator_group(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for group, ops in GROUPS.items():
        out = F.when(op.isin(*ops), group).otherwise(out)
    return out


@dataclass(frozen=True)
class State:
    """What q saves and Q brings back. Values are lexemes as given; places and matrices are numbers."""

    line_width: str | None = None
    line_cap: str | None = None
    line_join: str | None = None
    miter_limit: str | None = None
    dash: str | None = None
    stroke: str | None = None
    fill: str | None = None
    font: str | None = None
    leading: str | None = None
    char_space: str | None = None
    word_space: str | None = None
    scale: str | None = None
    rise: str | None = None
    ctm: Matrix = SAME


#: Operators that set one value, all their operands together.
SETS = {
    "w": "line_width", "J": "line_cap", "j": "line_join", "M": "miter_limit", "d": "dash", "G": "stroke", "RG": "stroke", "K": "stroke", "g": "fill", "rg": "fill", "k": "fill",
    "Tf": "font", "TL": "leading", "Tc": "char_space", "Tw": "word_space", "Tz": "scale", "Ts": "rise",
}


@dataclass
class Reader:
    """Reads operators one after another: the state and those saved, the path's current point, the text's matrices."""

    now: State = field(default_factory=State)
    saved: list[State] = field(default_factory=list)
    start: tuple[float, float] | None = None
    point: tuple[float, float] | None = None
    line: Matrix = SAME
    text: Matrix = SAME
    blocks: int = 0
    paths: int = 0
    inside: bool = False

    def take(self, op: str, operands: list[str]) -> None:
        if op in SETS:
            self.now = replace(self.now, **{SETS[op]: " ".join(operands)})
        elif op in GROUPS["path"]:
            self._path(op, operands)
        elif op in GROUPS["text"]:
            self._text(op, operands)
        elif op == "q":
            self.saved.append(self.now)
        elif op == "Q" and self.saved:
            self.now = self.saved.pop()
        elif op == "cm" and (m := numbers(operands, 6)):
            self.now = replace(self.now, ctm=product(m, self.now.ctm))

    def _path(self, op: str, operands: list[str]) -> None:
        """The current point is where the last piece of a path ended; a rectangle and a closed path end where they began."""
        if op == "h":
            self.point = self.start
            return
        found = numbers(operands, COUNTS[op])
        if found:
            self.point = found[:2] if op == "re" else found[-2:]
            if op in ("m", "re"):
                self.start = self.point

    def _next_line(self, x: float, y: float) -> None:
        self.line = self.text = product((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def _text(self, op: str, operands: list[str]) -> None:
        if op == "BT":
            self.blocks, self.inside, self.line, self.text = self.blocks + 1, True, SAME, SAME
        elif op == "ET":
            self.inside = False
        elif op == "Tm" and (m := numbers(operands, 6)):
            self.line = self.text = m
        elif op == "Td" and (move := numbers(operands, 2)):
            self._next_line(*move)
        elif op in ("T*", "'", '"'):
            if op == '"' and len(operands) >= 3:
                self.now = replace(self.now, word_space=operands[-3], char_space=operands[-2])
            lead = numbers([self.now.leading or "0"], 1)
            self._next_line(0.0, -lead[0] if lead else 0.0)

    def row(self, op: str) -> tuple:
        place = list(self.point) if self.point else None
        values = [getattr(self.now, name) for name in State.__dataclass_fields__ if name != "ctm"]
        return len(self.saved), self.blocks if self.inside or op == "ET" else None, self.paths, *values, list(self.now.ctm), place, list(self.text) if self.inside else None

    def end(self, op: str) -> None:
        if op in GROUPS["paint"]:  # painted paths are gone
            self.paths, self.start, self.point = self.paths + 1, None, None


_VALUES = ", ".join(f"{name} string" for name in State.__dataclass_fields__ if name != "ctm")
STATES = f"{OPS}, depth int, text_block int, path int, {_VALUES}, ctm array<double>, point array<double>, text_matrix array<double>"


def states(content: DataFrame) -> DataFrame:
    """Operators with what holds once they have run: depth of saved states, text block, path, all values of the state, its
    matrix, the path's current point, and within a text block the matrix at the start of what it shows next.

    A stream's state is a stack, so it is kept while the stream is read, in one pass. Null and empty streams have no rows; a
    stream that can't be read ends there; operands that can't be read change nothing.
    """

    def make(key: str, data: bytes) -> Iterator[tuple]:
        reader = Reader()
        try:
            for n, op, operands, text in parse_operators(data or b""):
                reader.take(op, operands)
                yield key, n, op, operands, text, fits(op, operands), *reader.row(op)
                reader.end(op)
        except ValueError:
            return

    return rows_of(content, STATES, make)


def numbers(operands: list[str], count: int) -> tuple[float, ...] | None:
    """The last operands as numbers, or None if there are fewer or one isn't a number."""
    try:
        found = tuple(float(x) for x in operands[-count:])
    except ValueError:
        return None
    return found if len(found) == count else None


def product(m: Matrix, n: Matrix) -> Matrix:
    """m applied ahead of n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def replayed(ops: DataFrame, doc: str = "doc_id", ord: str = "ord") -> DataFrame:
    """(doc, content): operators written back as streams, in order, a line each. What operators() reads from them is the same.

    A stream's operators meet in one row. Null operands are left out; a document without operators isn't there."""
    line = F.array_join(F.concat("operands", F.array("op")), " ")
    held = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), line.alias("s"))))
    return ops.groupBy(doc).agg(F.encode(F.array_join(F.transform(held, lambda x: x["s"]), "\n"), "ISO-8859-1").alias("content"))


FONT_MAP = "doc_id string, code int, text string"
_BFCHAR = re.compile(r"beginbfchar(.*?)endbfchar", re.S)
_PAIR = re.compile(r"(<[^>]*>)\s*(<[^>]*>)")


def bfchars(data: bytes) -> Iterator[tuple[int, str]]:
    """(code, text) of the single-character sections of a font's ToUnicode map; ranges aren't read."""
    for section in _BFCHAR.findall(data.decode("latin-1")):
        for code, to in _PAIR.findall(section):
            try:
                yield int.from_bytes(string_bytes(code), "big"), string_bytes(to).decode("utf-16-be", "replace")
            except ValueError:
                continue


def font_maps(content: DataFrame) -> DataFrame:
    """(doc_id, code, text) of ToUnicode streams (doc_id, content); of a code given twice both rows stay. Null streams have none."""

    def make(key: str, data: bytes) -> Iterator[tuple]:
        for code, text in bfchars(data or b""):
            yield key, code, text

    return rows_of(content, FONT_MAP, make)


def page_text(ops: DataFrame, doc: str = "doc_id", ord: str = "ord") -> DataFrame:
    """(doc, text): what text operators show, in order, a line for each line that they start. A document without any has the empty
    text; one without rows isn't there. A stream's operators meet in one row, as its text does."""
    line = F.when(F.col("op").isin("'", '"', "T*", "Td"), "\n").otherwise("")
    part = F.struct(F.col(ord).alias("o"), F.concat(line, F.coalesce("shown", F.lit(""))).alias("s"))
    held = F.array_sort(F.collect_list(F.when(F.col("op").isin(*GROUPS["text"]), part)))
    return ops.groupBy(doc).agg(F.ltrim(F.array_join(F.transform(held, lambda x: x["s"]), "")).alias("text"))
