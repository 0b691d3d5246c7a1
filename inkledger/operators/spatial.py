"""Spatial joins: boxes that overlap, nearest points, merged intervals.

A box or point belongs to the cells of a grid that it touches. Joins are by
page and cell, so a page's boxes never meet all against all; the exact test
and the removal of pairs found twice follow. The joins ask for a merge: sizes are
guessed far too low behind a generator, and Spark would broadcast a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions.measures import boxes_touch

PAGE = ["doc_id", "page_index"]


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def touching(left: DataFrame, right: DataFrame, pad: float = 0.0, cell: float = 24.0) -> DataFrame:
    """Left boxes (doc_id, page_index, key, x0, y0, x1, y1) that any right box of the page overlaps: doc_id, page_index, key."""
    a = left.withColumn("cy", _cells(F.col("y0") - pad, F.col("y1") + pad, cell)).withColumn("cx", _cells(F.col("x0") - pad, F.col("x1") + pad, 8 * cell)).alias("a")
    # One box to a cell and place will do for a test of existence.
    b = right.select(*PAGE, "x0", "y0", "x1", "y1").distinct().withColumn("cy", _cells(F.col("y0") - pad, F.col("y1") + pad, cell)).withColumn("cx", _cells(F.col("x0") - pad, F.col("x1") + pad, 8 * cell)).alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cx") == F.col("b.cx"))
    return a.join(b.hint("merge"), same & boxes_touch("a", "b", pad), "left_semi").select(*PAGE, "key").distinct()


def nearest(points: DataFrame, others: DataFrame, within: float = 0.8, cell: float = 8.0) -> DataFrame:
    """Each point (doc_id, page_index, id, x, y, ...) with ``near``: the nearest other at most ``within`` away, as distance, id and its further columns; ties to the smaller id.

    A point is in one cell only, so its others meet it in one task, and no shuffle follows the join.
    """
    keys = [*PAGE, "gx", "gy", "id"]
    a = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    more = [c for c in others.columns if c not in (*PAGE, "id", "x", "y")]
    b = others.select(*PAGE, F.struct("id", *more).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    b = b.withColumn("gx", _cells(F.col("ox") - within, F.col("ox") + within, cell)).withColumn("gy", _cells(F.col("oy") - within, F.col("oy") + within, cell))
    met = a.join(b.hint("merge"), [*PAGE, "gx", "gy"]).withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))).where(F.col("distance") <= within)
    own = [F.first(c).alias(c) for c in points.columns if c not in keys]
    best = met.groupBy(*keys).agg(F.min(F.struct("distance", "other")).alias("m"), *own)
    return best.select(*points.columns, F.struct(F.col("m.distance").alias("distance"), F.col("m.other.*")).alias("near"))


def merged_spans(spans: DataFrame, keys: list[str], gap: float = 20.0) -> DataFrame:
    """Spans (x0, x1) of each group, joined where they are at most ``gap`` apart."""
    order = W.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(F.col("x0") <= reach + gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return rows.groupBy(*keys, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _banded(rows: DataFrame, low: Column, high: Column, band: float) -> DataFrame:
    """A row to each band of a page's height that the interval touches."""
    return rows.withColumn("band", _cells(low, high, band))


def contained(lines: DataFrame, source: DataFrame, slack: float = 3.0, near: float = 2.4, gap: float = 20.0) -> DataFrame:
    """Lines (doc_id, page_index, row, y, x0, x1, size, mark) with ``inside``.

    The spans of all ``source`` lines (doc_id, page_index, y, x0, x1) of the page within ``near`` sizes are
    joined where they are ``gap`` apart or less. A line is inside if it lies in one of them, is centred as
    one is, or has only marks (``mark``) and hangs off one's end. Both meet by bands of the page, so a line gathers
    the few spans around it.
    """
    band = 24.0
    reach = near * F.greatest("size", F.lit(1.0))
    a = _banded(lines, F.col("y") - reach, F.col("y") + reach, band).alias("a")
    b = source.select(*PAGE, F.col("y").alias("sy"), F.least("x0", "x1").alias("l"), F.greatest("x0", "x1").alias("r")).withColumn("band", F.floor(F.col("sy") / band)).alias("b")
    met = a.join(b.hint("merge"), [*PAGE, "band"]).where(F.abs(F.col("sy") - F.col("y")) <= reach)
    spans = met.groupBy(*PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<l:double,r:double>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["l"].alias("l"), F.greatest(last["r"], x["r"]).alias("r"))))
        return F.when((F.size(done) > 0) & (x["l"] <= F.try_element_at(done, F.lit(-1))["r"] + gap), joined).otherwise(F.concat(done, F.array(x)))

    merged = spans.select(*PAGE, "row", F.aggregate("spans", empty, add).alias("spans"))
    size = F.greatest("size", F.lit(1.0))

    def holds(s: Column) -> Column:
        box = (F.col("x0") >= s["l"] - slack) & (F.col("x1") <= s["r"] + slack)
        axis = (F.abs((F.col("x0") + F.col("x1")) / 2 - (s["l"] + s["r"]) / 2) <= 8) & (F.col("x0") < s["r"] + size) & (F.col("x1") > s["l"] - size) & (F.col("x0") >= s["l"] - 1.5 * size) & (F.col("x1") <= s["r"] + 2.2 * size)
        hung = F.col("mark") & (F.col("x0") >= s["r"] - 1.5 * size) & (F.col("x1") <= s["r"] + 2.4 * size)
        return box | axis | hung

    inside = F.coalesce(F.exists("spans", holds), F.lit(False))
    return lines.join(merged.hint("merge"), [*PAGE, "row"], "left").select(*PAGE, "row", inside.alias("inside"))


def panel_edges(regions: DataFrame, width: float, height: float) -> DataFrame:
    """doc_id, page_index, edge, y0, y1: both sides of each region (x0..y1) at least 8 wide and 20 high that is not the page itself."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    panels = regions.where((w >= 8) & (h >= 20) & ~((w > 0.92 * width) & (h > 0.92 * height)))
    sides = F.explode(F.array(F.least("x0", "x1"), F.greatest("x0", "x1"))).alias("edge")
    return panels.select(*PAGE, sides, F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"))


def boundary_crossings(lines: DataFrame, source: DataFrame, edges: DataFrame, slack: float = 1.0) -> DataFrame:
    """doc_id, page_index, row, edge: lines (doc_id, page_index, row, x0, x1, y, size) that cross an edge which the matching source line doesn't.

    The matching line is that of the page whose baseline is nearest, within 0.8 of the greater size; without one
    nothing is said. Lines meet source lines and edges by bands of the page.
    """
    band = 24.0
    tall = lambda d: _banded(d, F.col("y") - 0.8 * F.col("size"), F.col("y") + 0.8 * F.col("size"), band)
    a = tall(lines.select(*PAGE, "row", "y", "size"))
    b = tall(source.select(*PAGE, F.col("row").alias("srow"), "y", "size", F.col("x0").alias("sx0"), F.col("x1").alias("sx1"))).withColumnsRenamed({"y": "sy", "size": "ssize"})
    met = a.join(b.hint("merge"), [*PAGE, "band"]).withColumn("dy", F.abs(F.col("y") - F.col("sy"))).where(F.col("dy") <= 0.8 * F.greatest("size", "ssize"))
    best = met.groupBy(*PAGE, "row").agg(F.min(F.struct("dy", "srow", "sx0", "sx1")).alias("m"))
    pad = F.greatest("size", F.lit(4.0))
    wide = _banded(lines, F.col("y") - pad, F.col("y") + pad, 4 * band)
    hit = wide.join(_banded(edges, F.col("y0"), F.col("y1"), 4 * band).hint("merge"), [*PAGE, "band"])
    hit = hit.where((F.col("y") + pad >= F.col("y0")) & (F.col("y") - pad <= F.col("y1")) & (F.col("x0") < F.col("edge") - slack) & (F.col("x1") > F.col("edge") + slack))
    hit = hit.select(*PAGE, "row", "edge").distinct().join(best.hint("merge"), [*PAGE, "row"])
    return hit.where(~((F.col("m.sx0") < F.col("edge") - slack) & (F.col("m.sx1") > F.col("edge") + slack))).select(*PAGE, "row", "edge")


def orphan_rules(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions (doc_id, page_index, key, kind, x0..y1) that are thin short paths with no glyph box beside them.

    A path counts if it is at most 1.6 high and 2 to 40 wide; a box (doc_id, page_index, x0..y1) is beside it if,
    with 16 more on the left and right and 6 above and below, it meets the path's middle line.
    """
    band = 24.0
    w, h, y = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), (F.col("y0") + F.col("y1")) / 2
    thin = regions.where((F.col("kind") == "path") & (h <= 1.6) & (w >= 2) & (w <= 40)).select(*PAGE, "key", F.least("x0", "x1").alias("x"), F.greatest("x0", "x1").alias("right"), y.alias("y"), w.alias("width"))
    a = thin.withColumn("band", F.floor(F.col("y") / band))
    b = boxes.select(*PAGE, (F.least("x0", "x1") - 16).alias("bx0"), (F.greatest("x0", "x1") + 16).alias("bx1"), (F.least("y0", "y1") - 6).alias("by0"), (F.greatest("y0", "y1") + 6).alias("by1"))
    b = b.withColumn("band", _cells(F.col("by0"), F.col("by1"), band))
    same = [a[c] == b[c] for c in (*PAGE, "band")]
    beside = (a.y >= b.by0) & (a.y <= b.by1) & (a.right >= b.bx0) & (a.x <= b.bx1)
    return a.join(b.hint("merge"), [*same, beside], "left_anti").select(*PAGE, "key", "x", "y", "width")
