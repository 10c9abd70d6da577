"""Folders that the driver and all executors see, and files written there through Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch between Spark and Python; values are long, and both sides hold a batch or two.
BATCH_BYTES = 2 << 20


def tuned(spark: SparkSession) -> None:
    """Bounds batches by their bytes, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64MB") in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, turned into Python's values one by one."""
    return (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True))


def packed(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of rows as they come, bounded by their number and by the bytes of their texts and binaries."""
    long = [k for k, f in enumerate(schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        held.clear()
        return out

    for row in rows:
        held.append(row)
        size += sum(len(row[k]) for k in long if row[k])
        if len(held) >= at_once or size >= BATCH_BYTES:
            yield batch()
            size = 0
    if held:
        yield batch()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a session on one machine gets a temporary one; on a
    cluster that is an error, as each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; without a live context there is nothing left to do."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a table in the shared folder, so that what is made of it needn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names that Spark's file systems go by, as pyarrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a folder, for files that tasks write or read by themselves.

    ValueError for a scheme that it doesn't know: what is kept there must be a table, which Spark writes."""
    scheme, mark, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest if mark else uri)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"files can't be written to {uri}: {e}") from None
