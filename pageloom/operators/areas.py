"""Exact areas of unions of rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.intervals import merge_runs

_c = F.col


def union_area(rects: DataFrame, keys: Sequence[str], cell: int = 256) -> DataFrame:
    """Area covered by the rectangles (x, y, w, h) of each key.

    Rectangles are cut at grid cells first, so a key with very many rectangles
    spreads over cells; inside a cell the distinct edges form slabs and each
    slab's intervals are merged.
    """
    tiles = lambda lo, size: F.explode(F.sequence(
        F.floor(lo / cell), F.greatest(F.floor(lo / cell), F.ceil((lo + size) / cell) - 1)))
    cut = (rects.where("w > 0 and h > 0").withColumn("_i", tiles(_c("x"), _c("w"))).withColumn("_j", tiles(_c("y"), _c("h")))
           .select(*keys, "_i", "_j",
                   F.greatest("x", _c("_i") * cell).alias("_l"), F.least(_c("x") + _c("w"), (_c("_i") + 1) * cell).alias("_r"),
                   F.greatest("y", _c("_j") * cell).alias("x0"), F.least(_c("y") + _c("h"), (_c("_j") + 1) * cell).alias("x1"))
           .groupBy(*keys, "_i", "_j", "_l", "_r", "x0").agg(F.max("x1").alias("x1")))
    place = [*keys, "_i", "_j"]
    # a cell's edges come by a window, not by a join: rows already dealt by a part of the keys stay where they are
    here = Window.partitionBy(*place)
    edges = F.sort_array(F.array_union(F.collect_set("_l").over(here), F.collect_set("_r").over(here)))
    inside = F.filter("_edges", lambda e: (e >= _c("_l")) & (e < _c("_r")))
    slabs = cut.withColumn("_edges", edges).withColumn("_slab", F.explode(inside))
    width = F.element_at("_edges", (F.array_position("_edges", _c("_slab")) + 1).cast("int")) - _c("_slab")
    merged = merge_runs(slabs.withColumn("_width", width), [*place, "_slab", "_width"])
    return merged.groupBy(*keys).agg(F.sum((_c("x1") - _c("x0")) * _c("_width")).alias("area"))


def readable_coverage(evidence: DataFrame, pages: DataFrame, max_scale: float = 2, required: float = 0.98) -> DataFrame:
    """Share of each page seen at a readable scale, per kind of evidence."""
    seen = union_area(evidence.where(_c("scale") <= max_scale), ["image_id", "kind"])
    return (evidence.select("image_id", "kind").distinct().join(seen, ["image_id", "kind"], "left")
            .join(pages.select("image_id", "width", "height"), "image_id")
            .withColumn("coverage", F.coalesce("area", F.lit(0)) / (_c("width") * _c("height")))
            .select("image_id", "kind", "coverage", (_c("coverage") >= required).alias("ready")))
