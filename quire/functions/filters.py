"""Stream filters: deflate with PNG predictors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes that deflating may cost beyond the plain form and still be taken.
SLACK = 30
#: Bytes that are predicted at once; the work takes many times their room.
PREDICTED = 1 << 18


class FilterError(ValueError):
    """A stream that can't be decoded; it is left as it is."""


def inflate(data: bytes) -> bytes:
    """zlib data; only blanks may follow its end."""
    machine = zlib.decompressobj()
    try:
        out = machine.decompress(data) + machine.flush()
    except zlib.error as e:
        raise FilterError(str(e)) from None
    if machine.unused_data.strip():
        raise FilterError("data after the end of the deflated stream")
    return out


def deflate(data: bytes) -> bytes | None:
    """Deflated data, or None where the plain form is kept."""
    out = zlib.compress(data)
    return out if len(out) < len(data) + SLACK else None


def _sub(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """Each byte adds the one a pixel to the left: a running sum in each lane."""
    padded = np.zeros(-(-len(row) // step) * step, np.uint8)
    padded[: len(row)] = row
    return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]


def _up(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    return row + up


def _average(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """Each byte needs the one just restored, so bytes go one by one."""
    out = [0] * step + row.tolist()
    for i, above in enumerate(up.tolist()):
        out[i + step] = (out[i + step] + ((out[i] + above) >> 1)) & 255
    return np.array(out[step:], np.uint8)


def _paeth(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    out, above = [0] * step + row.tolist(), [0] * step + up.tolist()
    for i in range(len(row)):
        a, b, c = out[i], above[i + step], above[i]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i + step] = (out[i + step] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.array(out[step:], np.uint8)


_UNDO = (lambda row, up, step: row.copy(), _sub, _up, _average, _paeth)


def unpredict(data: bytes, predictor: int = 15, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Rows of a PNG-predicted stream; each row's first byte names its filter. A short last row is filled up under predictor 15."""
    if predictor == 1:
        return data
    if not 10 <= predictor <= 15:
        raise FilterError(f"predictor {predictor} is not supported")
    width, step = (columns * colors * bits + 7) // 8, (colors * bits + 7) // 8
    short = -len(data) % (width + 1)
    if short and predictor != 15:
        raise FilterError("the data doesn't end with a row")
    rows = np.frombuffer(data + bytes(short), np.uint8).reshape(-1, width + 1)
    out, up = np.zeros((len(rows), width), np.uint8), np.zeros(width, np.uint8)
    for i, row in enumerate(rows):
        if row[0] >= len(_UNDO):
            raise FilterError(f"unknown row filter {row[0]}")
        up = out[i] = _UNDO[row[0]](row[1:], up, step)
    return out.tobytes()


def _guess(rows: np.ndarray, up: np.ndarray, kind: int, step: int) -> np.ndarray:
    """What a filter takes each byte for, from those to the left and above."""
    if kind == 0:
        return np.zeros_like(rows)
    if kind == 2:
        return up
    shift = lambda x: np.hstack([np.zeros((len(x), step), np.uint8), x])[:, : x.shape[1]]
    if kind == 1:
        return shift(rows)
    a, b = shift(rows).astype(np.int16), up.astype(np.int16)
    if kind == 3:
        return ((a + b) >> 1).astype(np.uint8)
    c = shift(up).astype(np.int16)
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def predict(data: bytes, kind: int, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """The other way: rows under one filter, for writing and for tests."""
    width, step = (columns * colors * bits + 7) // 8, (colors * bits + 7) // 8
    rows = np.frombuffer(data + bytes(-len(data) % width), np.uint8).reshape(-1, width)
    out = np.full((len(rows), width + 1), kind, np.uint8)
    for at in range(0, len(rows), most := max(1, PREDICTED // width)):
        part = rows[at : at + most]
        up = np.vstack([rows[at - 1 : at] if at else np.zeros((1, width), np.uint8), part[:-1]])
        out[at : at + most, 1:] = part - _guess(part, up, kind, step)
    return out.tobytes()


@F.pandas_udf(BinaryType())
def inflate_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else inflate(bytes(b)))


@F.pandas_udf(BinaryType())
def deflate_udf(data: pd.Series) -> pd.Series:
    """Deflated, whether or not that pays."""
    return data.map(lambda b: None if b is None else zlib.compress(bytes(b)))


def predict_udf(kind: int, columns: int):
    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else predict(bytes(b), kind, columns))

    return run


def unpredict_udf(columns: int):
    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else unpredict(bytes(b), 15, columns))

    return run


def running(data: bytes, kind: int, columns: int, colors: int) -> bytes:
    """Bytes that are differences under a row filter, summed up over the whole value; a short last row isn't filled up."""
    rows = np.frombuffer(data + bytes(-len(data) % (columns * colors)), np.uint8).reshape(-1, columns * colors)
    marked = np.hstack([np.full((len(rows), 1), kind, np.uint8), rows])
    return unpredict(marked.tobytes(), 15, columns, colors)[: len(data)]


def running_digest_udf(kind: int, columns: int, colors: int):
    """MD5 of the running sums in hexadecimal digits; null for null and for no bytes."""

    @F.pandas_udf(StringType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: hashlib.md5(running(bytes(b), kind, columns, colors).hex().upper().encode()).hexdigest() if b else None)

    return run
