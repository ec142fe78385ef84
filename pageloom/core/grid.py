"""Rectangle joins as equi-joins on page and grid cell.

Every box is copied to the cells it touches; a pair is emitted only in the
cell holding the top-left corner of its intersection, so no pair appears twice
and no distinct is needed.  The cell is part of the shuffle key, so a page
with very many boxes spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 256
#: Boxes of a page that are packed to one row and meet there, without cells.
FEW = 64


def _cells(low: Column, high: Column, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def with_cells(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    return (boxes
            .withColumn("_cx", _cells(F.col("x"), F.col("x") + F.col("w"), cell))
            .withColumn("_cy", _cells(F.col("y"), F.col("y") + F.col("h"), cell)))


def intersection(a: str, b: str) -> Column:
    """Overlap area of boxes held in columns ``<a>x`` ... and ``<b>x`` ..."""
    def side(p: str, s: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(a + p) + F.col(a + s), F.col(b + p) + F.col(b + s))
                          - F.greatest(F.col(a + p), F.col(b + p)))
    return side("x", "w") * side("y", "h")


def overlapping(left: DataFrame, right: DataFrame, page: str = "image_id", cell: int = CELL,
                condition: Column | None = None) -> DataFrame:
    """All (left, right) pairs with a positive overlap on the same page.

    Columns come back prefixed ``a_`` and ``b_`` beside the page key, plus
    ``inter``.  ``condition`` is applied inside the join.
    """
    a = with_cells(left, cell)
    b = with_cells(right, cell)
    a = a.select(page, "_cx", "_cy", *[F.col(c).alias("a_" + c) for c in left.columns if c != page])
    b = b.select(page, "_cx", "_cy", *[F.col(c).alias("b_" + c) for c in right.columns if c != page])
    top_x, top_y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    keep = ((F.col("a_x") < F.col("b_x") + F.col("b_w")) & (F.col("b_x") < F.col("a_x") + F.col("a_w"))
            & (F.col("a_y") < F.col("b_y") + F.col("b_h")) & (F.col("b_y") < F.col("a_y") + F.col("a_h"))
            & (F.floor(top_x / cell) == F.col("_cx")) & (F.floor(top_y / cell) == F.col("_cy")))
    if condition is not None:
        keep = keep & condition
    return (a.join(b, [page, "_cx", "_cy"]).where(keep)
            .withColumn("inter", intersection("a_", "b_")).drop("_cx", "_cy"))


def among(boxes: DataFrame, condition: Callable[[dict, dict], Column], page: str = "image_id", cell: int = CELL) -> DataFrame:
    """``overlapping`` of a table with itself, for pairs with ``condition(a, b)`` over the columns of both.

    Boxes are made and dealt by page once.  Those of a page with few boxes meet
    where they lie; a fuller page goes through the cells, as it may not fit a task.
    """
    columns = [c for c in boxes.columns if c != page]
    placed = boxes.repartition(page).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(page)))
    named = lambda p: {c: F.col(p + c) for c in columns}
    full = overlapping(placed.where(F.col("_n") > FEW).drop("_n"), placed.where(F.col("_n") > FEW).drop("_n"), page, cell,
                       condition(named("a_"), named("b_")))

    def meets(a: Column, b: Column) -> Column:
        return ((a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
                & condition({c: a[c] for c in columns}, {c: b[c] for c in columns}))
    packed = (placed.where(F.col("_n").between(2, FEW)).groupBy(page).agg(F.collect_list(F.struct(*columns)).alias("_items"))
              .select(page, F.explode("_items").alias("_b"), "_items"))
    met = packed.select(page, "_b", F.explode(F.filter("_items", lambda a: meets(a, F.col("_b")))).alias("_a"))
    few = met.select(page, *[F.col(f"_{s}")[c].alias(f"{s}_{c}") for s in "ab" for c in columns])
    return few.withColumn("inter", intersection("a_", "b_")).unionByName(full)


def paired(boxes: DataFrame, keep: Callable[[Column, Column], Column], pick: Callable[[Column, Column], Column],
           page: str = "image_id", cell: int = CELL) -> DataFrame:
    """``pick(a, b)`` of the pairs of overlapping boxes of one table that ``keep(a, b)``; a box also meets itself.

    The boxes of a cell are packed and meet there.  An aggregate takes tables dealt by page as they lie, which a
    join on page and cell doesn't; others spread by page and cell.
    """
    columns = [c for c in boxes.columns if c != page]
    packed = with_cells(boxes, cell).groupBy(page, "_cx", "_cy").agg(F.collect_list(F.struct(*columns)).alias("_items"))

    def meets(a: Column, b: Column) -> Column:
        return ((a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
                & (F.floor(F.greatest(a["x"], b["x"]) / cell) == F.col("_cx")) & (F.floor(F.greatest(a["y"], b["y"]) / cell) == F.col("_cy")) & keep(a, b))
    of = lambda b: F.transform(F.filter("_items", lambda a: meets(a, b)), lambda a: pick(a, b))
    return packed.select(page, F.explode(F.flatten(F.transform("_items", of))).alias("_p")).select(page, "_p.*")


def points_in_boxes(points: DataFrame, boxes: DataFrame, page: str = "image_id", cell: int = CELL) -> DataFrame:
    """Pairs of points (``px``, ``py``) and boxes holding them, edges included."""
    p = (points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell)))
    b = with_cells(boxes, cell).select(
        page, "_cx", "_cy", *[F.col(c).alias("b_" + c) for c in boxes.columns if c != page])
    return p.join(b, [page, "_cx", "_cy"]).where(
        F.col("px").between(F.col("b_x"), F.col("b_x") + F.col("b_w"))
        & F.col("py").between(F.col("b_y"), F.col("b_y") + F.col("b_h"))).drop("_cx", "_cy")
