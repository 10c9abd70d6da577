"""Media columns: texts as 8-bit WAV sound, read back and fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch, crc, documents, slices, tidy

#: Payloads are padded to a multiple of this, with this byte.
BLOCK, PAD = 576, b"\xff"
RATE, FRAME, HOP = 8000, 128, 64
#: Bins of the spectrum from which one peak a frame is taken, frames ahead in which a peak's partners lie, and frames transformed at once.
BANDS, AHEAD, AT_ONCE = ((1, 4), (4, 16), (16, 65)), (1, 2), 4096
TAIL = 32
ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media", pa.binary()), ("fingerprint", pa.list_(pa.int64())),
])
KINDS = {"int64": "long", "string": "string", "binary": "binary", "list<item: int64>": "array<long>"}


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded to a positive multiple of BLOCK; null is the empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (-len(data) % BLOCK if data else BLOCK)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


#: Nowhere 0, so that the first and the last sample count as well.
_WINDOW = np.hamming(FRAME)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band in each frame of the short-time Fourier transform, shape (frames, bands).

    Silence is added up to the next full hop, so every sample lies in a frame."""
    x = samples.astype(np.float64) - 128
    short = FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, short)), FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), AT_ONCE):
        power = np.abs(np.fft.rfft(frames[i : i + AT_ONCE] * _WINDOW, axis=1))
        power = np.round(power, 6)  # equal sound, equal peaks, whatever the order of sums
        for k, (low, high) in enumerate(BANDS):
            out[i : i + AT_ONCE, k] = low + power[:, low:high].argmax(axis=1)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of peaks as time << 32 | bin << 22 | partner's bin << 12 | band << 8 | frames between, in order of time."""
    found = peaks(samples)
    at = np.arange(len(found), dtype=np.int64)
    codes = [at[:-d, None] << 32 | found[:-d] << 22 | found[d:] << 12 | np.arange(len(BANDS)) << 8 | d for d in AHEAD if len(found) > d]
    return np.sort(np.concatenate([c.ravel() for c in codes])) if codes else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, columns: tuple[str, ...] = tuple(ROWS.names)) -> DataFrame:
    """The media of every row: its stored form, sizes, hashes of what is read back, and the fingerprint.

    Null and empty texts are one block of padding. Ids are carried, null ones too; equal texts have equal values. Only
    the columns asked for are made.
    """
    schema = pa.schema([ROWS.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, k in slices(texts):
                made: dict[str, list] = {c: [] for c in ROWS.names}
                for key, text in zip(keys[i:k], texts[i:k], strict=True):
                    size, data = payload(text)
                    stored = to_wav(data)
                    back = from_wav(stored)
                    marks = fingerprint(np.frombuffer(back, np.uint8)) if "fingerprint" in columns else None
                    for c, v in zip(ROWS.names, (key, size, len(back), hashlib.sha256(back).hexdigest(), crc(back[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), stored, marks), strict=True):
                        made[c].append(v)
                yield batch(schema, **{c: made[c] for c in columns})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), ", ".join(f"{f.name} {KINDS[str(f.type)]}" for f in schema))


def op9_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = tuple(c for c in ROWS.names if c != "media")
    made = media_columns(documents(spark, sf_dir), columns)
    # a digest of the time-coded array stands for it
    return made.withColumn("feature", F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256))).drop("fingerprint")
