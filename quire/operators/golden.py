"""Results held against accepted digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a golden table that aren't digests, and the mark of a digest that is known to be wrong.
SKIP, EXPECTED, BAD = "skip", "xfail", "!"


def compared(results: DataFrame, golden: DataFrame, on: list[str], digest: str = "digest") -> DataFrame:
    """Results with a status: ok, skipped, known bad, expected failure, changed, or missing where no digest was ever accepted.

    A key may have several accepted digests; its entries meet in one row, as many as someone wrote down. A null digest is
    changed, unless its key is skipped; results are answered each, null keys are missing.
    """
    held = golden.groupBy(*on).agg(F.collect_set(digest).alias("_accepted"))
    has = lambda c: F.coalesce(F.array_contains("_accepted", c), F.lit(False))
    status = (
        F.when(F.col("_accepted").isNull(), "missing").when(has(F.lit(SKIP)), "skipped").when(has(F.col(digest)), "ok").when(has(F.concat(F.lit(BAD), F.col(digest))), "known bad")
        .when(has(F.lit(EXPECTED)), "expected failure").otherwise("changed")
    )
    return results.join(held, on, "left").withColumn("status", status).drop("_accepted")


def intersects(a: Column, b: Column, *apart: str) -> Column:
    """Whether two arrays have an element in common, some elements apart."""
    keep = lambda x: F.filter(x, lambda v: ~v.isin(*apart)) if apart else x
    return F.arrays_overlap(keep(a), keep(b))
