"""Objects of a file as rows: revisions, offsets, content parts, overlays, fragments.

Null keys are a group of their own; repeated rows count each time; empty tables give empty ones; columns that an operator
adds must not be there already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(entries: DataFrame, keys: list[str], revision: str, columns: list[str]) -> DataFrame:
    """The newest entry of each key; aggregated before the shuffle, so often-revised keys don't gather their history.

    Of entries of one revision the one with the larger columns, in their order, counts; null revisions are the oldest.
    """
    newest = F.max(F.struct(F.col(revision).alias("_at"), *columns)).alias("_new")
    return entries.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_new.{c}").alias(c) for c in columns])


def first_entries(entries: DataFrame, keys: list[str], place: str, columns: list[str]) -> DataFrame:
    """Of a section's entries for one object the first counts."""
    return entries.groupBy(*keys).agg(F.min(F.struct(F.col(place).alias("_at"), *columns)).alias("_one")).select(*keys, *[F.col(f"_one.{c}").alias(c) for c in columns])


def offsets(objects: DataFrame, file: list[str], order: list[str], length: Column, header: int = 15) -> DataFrame:
    """Each object's byte offset: the header and all bodies ahead of it. `length` is in bytes; a null one takes no room."""
    ahead = Window.partitionBy(*file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.coalesce(F.sum(length).over(ahead), F.lit(0)) + header)


def xref_line(offset: Column, generation: Column, used: Column) -> Column:
    return F.format_string("%010d %05d %s", offset, generation, F.when(used, "n").otherwise("f"))


def containers(members: DataFrame, container: list[str], member: str) -> DataFrame:
    """Object streams with the number of their members, the first and last of them, and all in order.

    A stream's members are read together, as they lie in one stream."""
    return members.groupBy(*container).agg(F.count("*").alias("members"), F.min(member).alias("first_member"), F.max(member).alias("last_member"), F.array_sort(F.collect_list(member)).alias("member_list"))


def joined_parts(parts: DataFrame, page: list[str], order: str, data: str, between: str = "\n") -> DataFrame:
    """Content parts of a page as one: in order, a line feed between them; null parts are empty. Adds their number and the
    joined length in bytes. A page's parts meet in one row, as they do in its stream."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(data, F.lit("")).alias("d"))))
    return parts.groupBy(*page).agg(F.array_join(F.transform(held, lambda x: x["d"]), between).alias("content"), F.count("*").alias("parts")).withColumn("n_bytes", F.octet_length("content").cast("long"))


def envelope(boxes: DataFrame, group: list[str], x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> DataFrame:
    """The smallest box around all boxes of a group."""
    return boxes.groupBy(*group).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(F.col(x) + F.col(w)).alias("x1"), F.max(F.col(y) + F.col(h)).alias("y1"))


def overlay_names(overlays: DataFrame, page: list[str], z: str, existing: str, prefix: str) -> DataFrame:
    """Names for a page's overlays in order of painting: numbers go on behind the largest that the page has. Overlays that are
    painted at once are numbered in the order of their other columns, so that reruns agree."""
    order = Window.partitionBy(*page).orderBy(z, *[c for c in overlays.columns if c != z and c not in page and c != existing])
    return overlays.withColumn("name", F.concat(F.lit(prefix), (F.coalesce(existing, F.lit(-1)) + F.row_number().over(order)).cast("string")))


def painted(overlays: DataFrame, page: list[str], z: str, name: str) -> DataFrame:
    """What an overlaid page paints: items below the page, the page itself between q and Q, items above it."""
    items = F.array_sort(F.collect_list(F.struct(F.col(z).alias("z"), F.concat(F.col(name), F.lit(" Do")).alias("s"))))
    part = lambda keep: F.array_join(F.transform(F.filter(F.col("items"), keep), lambda x: x["s"]), "\n")
    made = overlays.groupBy(*page).agg(items.alias("items"))
    return made.select(*page, part(lambda x: x["z"] < 0).alias("before"), part(lambda x: x["z"] > 0).alias("after"), F.exists("items", lambda x: x["z"] > 0).alias("guarded"))


#: Words of a form that only places others: these operators, names, and digits among dots and dashes.
PLACING, DIGITS = ("q", "Q", "cm", "Do"), "[.-]*[0-9][0-9.-]*"


def trivial(stream: Column, most: int = 300) -> Column:
    """Whether a form only places others: short, and nothing but numbers, names and q Q cm Do. Null for null."""
    words = F.filter(F.split(stream, "[\\x00\\t\\n\\f\\r ]+"), lambda w: w != "")
    return (F.length(stream) < most) & F.forall(words, lambda w: w.isin(*PLACING) | w.startswith("/") | w.rlike(f"^{DIGITS}$"))


def fragment_page(width: Column, height: Column, page_width: float = 612, margin: float = 0, name: str = "/Fragment0") -> tuple[Column, Column, Column]:
    """Page width, height, and content of a page that shows one image within margins."""
    w = F.lit(float(page_width)) - 2 * margin
    h = height * w / width
    content = F.concat(F.lit("q "), _num(w), F.lit(" 0 0 "), _num(h), F.lit(f" {margin:g} {margin:g} cm {name} Do Q"))
    return F.lit(float(page_width)), h + 2 * margin, content


def _num(x: Column) -> Column:
    from quire.functions.strings import number_column

    return number_column(x)
