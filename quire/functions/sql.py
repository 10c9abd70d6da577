"""The functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions import filters, strings

#: SQL names of Arrow functions over one column; a null stays null, what can't be read ends the query.
FUNCTIONS = {
    "pdf_string_bytes": strings.literal_bytes_udf, "pdf_string_text": strings.text_udf, "pdf_name": strings.name_decode_udf,
    "pdf_inflate": filters.inflate_udf, "pdf_deflate": filters.deflate_udf,
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them; returns their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return list(FUNCTIONS)
