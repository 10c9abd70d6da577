"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents are shuffled by a hash, and each source serves its own lap after lap. A copy's virtual finish time is the words
that its source has served by its end, divided by the source's target. Copies of all sources are sorted into ranges of
virtual time; sums of ranges give the words ahead of each, and the mix is cut where the budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, documents, written

#: Shares of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all words; and the most that a source may be repeated.
BUDGET, MOST = 1.5, 2
ROWS_PER_BUCKET = 4096
#: Equal rows that are numbered in one go.
AT_ONCE = 1 << 16


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources from (source, source_size), one row a source.

    Weights are dealt in code-point order, null last. Sources are filled like vessels: in order of cap / weight, a
    source is full if its cap lies below the level that the rest would share, and the first that isn't sets the level.
    The windows below run over one row a source, not over documents.
    """
    every, ranked = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(every)).withColumn("weight", weight.cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    rest = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(whole).cast("double") * BUDGET)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(whole)
    s = s.withColumn("share", first["level"])
    return s.select("source", "source_size", "weight", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def _buckets(rows: int) -> int:
    """Hexadecimal digits that name buckets of about ROWS_PER_BUCKET rows."""
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < rows and digits < 7:
        digits += 1
    return digits


def _src() -> Column:
    """A key for the source; a null one and an empty one differ."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, src, size, k, kind, n): rows that are alike, counted before anything is shuffled.

    k is a row's place in the shuffle. A column `kind` of `docs` parts rows that differ in more than id, source and text.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kind = F.col("kind") if "kind" in docs.columns else F.lit("").alias("kind")
    rows = docs.select(F.col("doc_id").cast("long"), "source", _src(), size, F.md5(name.cast("binary")).alias("k"), kind)
    return written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "sized")


def queued(rows: DataFrame) -> DataFrame:
    """Copies of documents in the order of service, each with its virtual finish time and the words taken of it.

    `rows` are of sized(). A first copy of every row, and a second one where the second lap comes so far: doc_id, source, size,
    k, kind, nth (of equal rows), lap, source_size, target, before (words of its source ahead of it), got (its words up to
    the target), finish (of what it got), at (words of the mix ahead of it), taken (its words up to the budget).
    """
    whole = rows.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    digits, budget = _buckets(whole["rows"]), int(whole["words"] * BUDGET)
    rows = rows.withColumn("b", F.substring("k", 1, digits)).withColumn("words", F.col("size") * F.col("n"))

    parts = rows.groupBy("src", "b").agg(F.first("source").alias("source"), F.sum("words").alias("part"))
    of = targets(parts.groupBy("src").agg(F.first("source").alias("source"), F.sum("part").alias("source_size")).drop("src"))
    ahead = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0))).select("src", "b", "ahead").join(of.select(_src(), "source_size", "target"), "src")
    within = Window.partitionBy("src", "b").orderBy("k", "doc_id", "size", "kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0))).join(parts, ["src", "b"])

    zero = F.lit(0).cast("long")
    placed = placed.withColumn("run", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / AT_ONCE))))
    if whole["most"] > AT_ONCE:
        placed = placed.repartition("src", "k", "run")
    last = F.least(F.col("run") * AT_ONCE + AT_ONCE, "n") - 1
    copies = placed.withColumn("nth", F.explode(F.sequence(F.col("run") * AT_ONCE, last))).withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    copies = copies.withColumn("before", F.col("ahead") + F.col("inside") + F.col("nth") * F.col("size") + F.col("lap") * F.col("source_size"))
    copies = copies.withColumn("got", F.greatest(zero, F.least("size", F.floor("target") - F.col("before")))).where("lap = 0 OR got > 0")
    copies = copies.withColumn("finish", F.when(F.col("got") > 0, (F.col("before") + F.col("got")) / F.col("target")))

    # all sources in one order: ranges of virtual time, the words of the ranges ahead, and those ahead within a range; copies
    # that got nothing lie in ranges of their own, below 0
    ranges = 16**digits
    served = F.least(F.floor(F.col("finish") * float(ranges)), F.lit(ranges - 1).cast("long"))
    copies = copies.withColumn("range", F.when(F.col("got") > 0, served).otherwise(-1 - F.pmod(F.xxhash64("k", "nth"), F.lit(ranges))))
    sums = copies.groupBy("range").agg(F.sum("got").alias("part"))
    sums = sums.select("range", F.coalesce(F.sum("part").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("upto"))  # a row a range
    inside = Window.partitionBy("range").orderBy("finish", "src", "k", "doc_id", "kind", "nth", "lap").rowsBetween(Window.unboundedPreceding, -1)
    out = copies.withColumn("inner", F.coalesce(F.sum("got").over(inside), F.lit(0))).join(sums, "range").withColumn("at", F.when(F.col("got") > 0, F.col("upto") + F.col("inner")))
    taken = F.greatest(zero, F.least(F.col("got"), F.lit(budget).cast("long") - F.coalesce("at", zero)))
    return out.select("doc_id", "source", "size", "k", "kind", "nth", "lap", "source_size", "target", "before", "got", "finish", "at", taken.alias("taken"))


def schedule(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, before, taken, finish, at) of every row.

    The shuffle is the order of md5 of the id and the text, the same in each run. `taken` are the words that the mix takes of
    the row, both laps, `before` the words of its source ahead of it, `finish` the virtual finish time of the whole first copy
    (null if the target is 0), `at` the words of the mix ahead of what is taken first (null where nothing is). Null texts have
    size 0 and take 0. Null ids sort first, null sources are one source of their own, repeated rows are served one by one.
    """
    first = F.col("before") - F.col("lap") * F.col("source_size")
    held = queued(sized(docs)).groupBy("doc_id", "source", "size", "k", "nth", "source_size", "target", first.alias("before")).agg(F.sum("taken").alias("taken"), F.min("at").alias("at"))
    return held.select("doc_id", "source", "size", "source_size", "target", "before", "taken", F.try_divide(F.col("before") + F.col("size"), F.col("target")).alias("finish"), "at")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: a row for each copy of which at least half is taken, sorted by virtual finish time.

    Columns as in `docs`, which needs doc_id, text and source; other columns are carried along, whatever their names.
    A document of size 0 has nothing to take and is left out. Texts stay out of the queue and are joined to its result.
    """
    other = [F.col(f"`{c}`") for c in docs.columns]
    kind = F.md5(F.to_json(F.struct(*[c.cast("string") for c in other])).cast("binary")).alias("kind")
    rows = sized(docs.select("doc_id", "source", "text", kind))
    copies = queued(rows).where("taken > 0 AND 2 * taken >= size").select("kind", "at")
    held = docs.select(F.struct(*other).alias("held"), kind)
    if not rows.where("n > 1").isEmpty():  # equal rows are one text, of which each copy takes its own
        held = held.dropDuplicates(["kind"])
    return held.join(copies, "kind").orderBy("at").select("held.*")


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "finish")


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
      source_size::DOUBLE * 2 AS cap FROM r),
c AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT level AS share FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT share FROM f) IS NULL THEN cap
      ELSE least(cap, (SELECT share FROM f) * weight) END AS target FROM l),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - before))
   + greatest(0, least(size, floor(target)::BIGINT - before - source_size)))::BIGINT AS taken,
  CASE WHEN target = 0 THEN NULL ELSE (before + size)::DOUBLE / target END AS finish
FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
"""
