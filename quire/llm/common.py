"""Helpers that the training-data operators share: paths, written tables, hashes and word rules."""

from __future__ import annotations

import ctypes
import gc
import os
import weakref
import zlib
from collections.abc import Callable, Iterator, Sized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import shared
from quire.sources.shared import tuned

#: A word is a run of anything but these ASCII blanks; bytes.split() cuts at exactly the same six.
WORD = "[^\\x20\\x09-\\x0D]+"


#: glibc's call that returns free memory to the system; other libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    tuned(spark)
    return shared.scratch(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: later stages reread it instead of computing it again, also after an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out, lambda _, k=id(out): _tables.pop(k, None)), path)
    return out


#: Where written frames lie, for as long as they are referred to.
_tables: dict[int, tuple[weakref.ref, str]] = {}


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of written frames, once all that is made of them has been written as well."""
    for df in frames:
        if held := _tables.pop(id(df), None):
            shared.remove(df.sparkSession, held[1])


#: Words and pieces of more characters aren't kept by workers, so that a bound on their number bounds their bytes.
LONG = 64


#: What workers keep between tasks, by name, with the call that drops it.
_stores: dict[str, Callable[[], None]] = {}


def kept(name: str, held: Sized) -> None:
    """Names a store of this worker; tasks of other operators drop it."""
    _stores[name] = lambda: held.clear() if len(held) else None


def drop(keeps: str = "") -> None:
    """Drops this worker's stores but the one it `keeps`. Tasks' functions are copied with what they name, so they must name this call, not the stores."""
    for other, clear in _stores.items():
        if other != keeps:
            clear()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that first drops what other operators' tasks have left in a worker that is used again, but for the
    store it `keeps`, and leaves no free memory behind: a worker may wait for long while others work beside it."""

    def task(batches: Iterator) -> Iterator:
        drop(keeps)
        gc.collect()
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased and no other letter; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about `most` characters each, so that work arrays stay small; one long text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the splitmix64 finaliser); overflow wraps."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; QUIRE_TOKENIZERS names another folder."""
    folder = os.environ.get("QUIRE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
