"""Incremental ingestion: new files as they arrive, and the newest revision of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: What a binaryFile source has; a stream must name it.
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*.pdf", at_once: int = 1000) -> DataFrame:
    """(doc_id, content, modified, length) of files as they appear; the tables of sources.pdf take it as it is."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(path)
    return found.select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("modified"), "length")


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def newest(stream: DataFrame, keys: list[str], time: str, columns: list[str], late: str = "1 day") -> DataFrame:
    """The newest row of each key within the watermark, for update mode: a key comes again whenever it has a newer row, and its
    state is dropped once the watermark has passed it. Of rows of one time the one with the larger columns counts."""
    held = stream.withWatermark(time, late).groupBy(*keys, F.window(time, late).alias("_span")).agg(F.max(F.struct(time, *columns)).alias("_new"))
    return held.select(*keys, F.col(f"_new.{time}").alias(time), *[F.col(f"_new.{c}").alias(c) for c in columns])


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: files that arrive twice are read once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to a Parquet folder and stops; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_newest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keeps the rows of newest() below a folder, a table for each batch, named by its number.

    A batch holds the keys that it has news of. One that runs again after a failure writes its own table anew, and readers see
    whole tables only. newest_rows() puts them together; merge() does the same once and for all."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_rows(spark: SparkSession, path: str, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """What the batches below a folder say of each key at last; aggregated before the shuffle."""
    held = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return held.groupBy(*keys).agg(F.max(F.struct(time, *columns)).alias("_new")).select(*keys, F.col(f"_new.{time}").alias(time), *[F.col(f"_new.{c}").alias(c) for c in columns])


def merge(spark: SparkSession, path: str, out: str, keys: list[str], time: str, columns: list[str]) -> None:
    """The newest rows so far as one table in a new folder; the batches stay until their owner deletes them."""
    newest_rows(spark, path, keys, time, columns).write.parquet(out)
