"""Encrypted documents as tables: their keys, and their streams in the clear."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import crypt
from quire.sources.pdf import checked, rows_of
from quire.sources.sealing import seal

KEYS = "doc_id string, method string, key binary, password_fits boolean"


def keys(content: DataFrame, password: bytes = b"", mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each encrypted document: its method (null if unknown), key, and whether the password is the user's."""

    def make(key: str, data: bytes) -> Iterator[tuple]:
        doc = checked(key, data, mode)
        if doc is None or doc.status != "encrypted":
            return
        found = seal(doc, password)
        yield (key, found.default, found.key, found.fits) if found else (key, None, None, False)

    return rows_of(content, KEYS, make)


def unsealed(objects: DataFrame, found: DataFrame) -> DataFrame:
    """The object table with streams decrypted where the document has a key; cross-reference streams are never sealed,
    and a stream that names a filter of its own for encryption keeps its bytes. The password that sources.pdf's tables take
    opens those as well, in the tasks that parse."""
    both = objects.join(found.select("doc_id", "method", "key"), "doc_id", "left")
    sealed = F.col("stream").isNotNull() & F.coalesce(F.col("type") != "/XRef", F.lit(True)) & ~F.array_contains("filter", "/Crypt")
    n, g = F.col("objnum"), F.col("gennum")
    rc4 = crypt.rc4_udf("stream", crypt.object_key_column(F.col("key"), n, g, False))
    aes = crypt.aes_stream_column(F.col("stream"), F.col("key"), n, g)
    clear = F.when(sealed & (F.col("method") == "rc4"), rc4).when(sealed & (F.col("method") == "aes"), aes).otherwise(F.col("stream"))
    return both.withColumn("stream", clear).withColumn("length", F.octet_length("stream").cast("long")).drop("method", "key")
