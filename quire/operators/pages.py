"""Page algebra: whole documents are rearranged as tables of pages.

Frames have a document column and a page number from 1; both names are parameters. Nothing collects, and only frames
whose size is a parameter of the call (ranges, one stamp) are joined to all others.

Rows with a null page number have no place: they are in no range, and on no sheet; rows with a null document are one document.
Repeated rows are pages of their own, in any order among each other. Empty tables give empty ones. Columns that an operator
adds must not be there already; all others are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pages that are numbered together.
RANGE = 4096


def _ranges(page: Column, ranges: list[tuple[int, int]]) -> list[Column]:
    return [page.between(a, b) for a, b in ranges]


def subset(pages: DataFrame, ranges: list[tuple[int, int]], doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Pages of ranges, in the order of the ranges; a page that lies in two comes twice. Adds out_page."""
    starts = [sum(b - a + 1 for a, b in ranges[:k]) for k in range(len(ranges))]
    places = F.filter(F.array(*[F.when(hit, F.col(page) - a + s) for hit, (a, _), s in zip(_ranges(F.col(page), ranges), ranges, starts, strict=True)]), lambda x: x.isNotNull())
    hit = pages.withColumn("_at", F.explode(places))
    return hit.withColumn("out_page", F.row_number().over(Window.partitionBy(doc).orderBy("_at"))).drop("_at")


def concatenate(parts: list[DataFrame], by: str | None = None, page: str = "page_no") -> DataFrame:
    """Pages of all parts behind each other; adds part and out_page. `by` names what the result is numbered within.

    Without it all parts are one sequence, numbered range by range of pages, so that no task sorts them all."""
    every = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    if by:
        return every.withColumn("out_page", F.row_number().over(Window.partitionBy(by).orderBy("part", page)))
    every = every.withColumn("_range", F.coalesce(F.floor(F.col(page) / RANGE), F.lit(-1)))
    counts = every.groupBy("part", "_range").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("part", "_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("part", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("part", "_range").orderBy(page))
    return every.withColumn("_in", within).join(counts, ["part", "_range"]).withColumn("out_page", (F.col("_ahead") + F.col("_in")).cast("int")).drop("_range", "_in", "_ahead")


def rotate(pages: DataFrame, degrees: int, ranges: list[tuple[int, int]] | None = None, page: str = "page_no", rotation: str = "rotate") -> DataFrame:
    """Turns pages; those in several ranges are turned as often, without ranges all are."""
    if degrees % 90:
        raise ValueError("pages turn by right angles")
    hits = reduce(lambda x, y: x + y, [h.cast("int") for h in _ranges(F.col(page), ranges)]) if ranges else F.lit(1)
    return pages.withColumn(rotation, F.pmod(F.coalesce(F.col(rotation), F.lit(0)) + degrees * hits, F.lit(360)))


def grid(pages: DataFrame, page: str = "page_no", columns: int = 2, rows: int = 2, scale: float = 0.5) -> DataFrame:
    """Several pages a sheet, row by row from the top left; adds sheet, slot, and x and y as shares of a scaled page."""
    slot = ((F.col(page) - 1) % (columns * rows)).cast("int")
    return pages.withColumns({
        "sheet": F.floor((F.col(page) - 1) / (columns * rows)) + 1, "slot": slot, "scale": F.lit(scale),
        "x": (slot % columns).cast("double"), "y": (F.lit(rows - 1) - F.floor(slot / columns)).cast("double"),
    })


def booklet(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", multiple: int = 4) -> DataFrame:
    """Sheets of a folded booklet: (doc, sheet, left_page, right_page), null for a blank.

    Pages are filled up to a multiple; sheet s holds page s and the one as far from the end, the outer one on the
    left of odd sheets and on the right of even ones.
    """
    count = pages.groupBy(doc).agg(F.max(page).alias("last"))
    n = (F.ceil(F.col("last") / multiple) * multiple).cast("int")
    sheets = count.select(doc, "last", n.alias("n"), F.explode(F.sequence(F.lit(1), (n / 2).cast("int"))).alias("sheet"))
    present = lambda c: F.when(c <= F.col("last"), c)
    outer, inner = F.col("n") + 1 - F.col("sheet"), F.col("sheet")
    odd = F.col("sheet") % 2 == 1
    return sheets.select(doc, "sheet", F.when(odd, present(outer)).otherwise(present(inner)).alias("left_page"), F.when(odd, present(inner)).otherwise(present(outer)).alias("right_page"))


def signatures(pages: DataFrame, size: int = 20, doc: str = "doc_id", page: str = "page_no", multiple: int = 4) -> DataFrame:
    """Booklets of `size` pages each; adds signature, pages are counted within it."""
    cut = pages.withColumn("signature", (F.floor((F.col(page) - 1) / size) + 1).cast("int")).withColumn(page, ((F.col(page) - 1) % size + 1).cast("int"))
    keyed = cut.withColumn("_doc", F.struct(doc, "signature"))
    made = booklet(keyed, "_doc", page, multiple)
    first = (F.col("signature") - 1) * size
    return made.select(F.col(f"_doc.{doc}").alias(doc), F.col("_doc.signature").alias("signature"), "sheet", "left_page", "right_page").withColumns({c: F.col(c) + first for c in ("left_page", "right_page")})


def twice(pages: DataFrame, page: str = "page_no") -> DataFrame:
    """The same page twice on a sheet, heads together: adds copy (0, 1) and turn, swapped on even pages."""
    return pages.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("turn", F.when((F.col(page) + F.col("copy")) % 2 == 1, 0).otherwise(180))


def halves(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """A spread as its left and right half: adds half, view_x, view_w as shares of the page, and out_page."""
    out = pages.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.withColumns({"view_x": F.col("half") * 0.5, "view_w": F.lit(0.5), "out_page": 2 * F.col(page) - 1 + F.col("half")})


def poster(pages: DataFrame, margin: float = 36, scale: float = 4.8, page: str = "page_no", width: str = "width", height: str = "height") -> DataFrame:
    """The first page of each document without its margin, enlarged: adds view_w, view_h, out_w, out_h."""
    first = pages.where(F.col(page) == 1)
    out = first.withColumns({"view_w": F.col(width) - 2 * margin, "view_h": F.col(height) - 2 * margin})
    return out.withColumns({"out_w": F.col("view_w") * scale, "out_h": F.col("view_h") * scale})


def stamp(pages: DataFrame, mark: DataFrame, under: bool = False) -> DataFrame:
    """A stamp of one row on (or under) every page: z is the order of painting, the page itself is 0.

    The stamp is cut to one row, so sending it to all tasks is bounded.
    """
    return pages.join(F.broadcast(mark.limit(1)), how="cross").withColumn("z", F.lit(-1 if under else 1))


def fitted_stamp(pages: DataFrame, mark: DataFrame, page: str = "page_no", width: str = "width", mark_width: str = "mark_width") -> DataFrame:
    """A stamp scaled down to pages narrower than it, at the left edge of odd pages and the right one of even pages."""
    out = pages.join(F.broadcast(mark.limit(1)), how="cross").withColumn("scale", F.least(F.lit(1.0), F.col(width) / F.col(mark_width)))
    return out.withColumn("mark_x", F.when(F.col(page) % 2 == 1, 0.0).otherwise(F.col(width) - F.col("scale") * F.col(mark_width)))
