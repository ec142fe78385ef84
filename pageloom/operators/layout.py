"""Geometric joins: overlap, containment, container trees, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core import grid

_c = F.col
BOX = ["x", "y", "w", "h"]


def _area(p: str) -> Column:
    return _c(p + "w") * _c(p + "h")


def box_iou_join(boxes: DataFrame, min_iou: float) -> DataFrame:
    """Pairs on a page with inter / max(1, union) >= ``min_iou``."""
    b = boxes.select("image_id", "region_id", *BOX)
    pairs = grid.overlapping(b, b, condition=_c("a_region_id") < _c("b_region_id"))
    union = F.greatest(F.lit(1), _area("a_") + _area("b_") - _c("inter"))
    return (pairs.withColumn("iou", _c("inter") / union).where(_c("iou") >= min_iou)
            .select("image_id", _c("a_region_id").alias("first_id"), _c("b_region_id").alias("second_id"), "iou"))


def box_coverage_join(inner: DataFrame, outer: DataFrame, share: float) -> DataFrame:
    """(inner, outer) pairs whose overlap covers ``share`` of the inner box."""
    cols = ["image_id", "region_id", *BOX]
    pairs = grid.overlapping(inner.select(*cols), outer.select(*cols),
                             condition=_c("a_region_id") != _c("b_region_id"))
    return (pairs.withColumn("coverage", _c("inter") / F.greatest(F.lit(1), _area("a_")))
            .where(_c("coverage") >= share)
            .select("image_id", _c("a_region_id").alias("inner_id"), _c("b_region_id").alias("outer_id"), "coverage"))


def smallest_container(items: DataFrame, containers: DataFrame, share: float = 0.5) -> DataFrame:
    """Items with the smallest box holding ``share`` of them, or null.

    Ties go to the higher, then righter, then lower label, then lower id.
    """
    cols = ["image_id", "region_id", *BOX]
    pairs = grid.overlapping(items.select(*cols), containers.select(*cols, "label"))
    held = pairs.where((_area("a_") > 0) & (_c("inter") / _area("a_") >= share))
    best = held.groupBy("image_id", _c("a_region_id").alias("region_id")).agg(F.min_by(
        _c("b_region_id"),
        F.struct(_area("b_").alias("area"), _c("b_y"), (-_c("b_x")).alias("x"), _c("b_label"), _c("b_region_id")),
    ).alias("container_id"))
    return items.join(best, ["image_id", "region_id"], "left")


def layout_tree(predictions: DataFrame) -> DataFrame:
    """Parent, panel and pre-order position of every prediction on its page.

    Predictions meet among themselves once.  Best containers come with their
    order keys, and a text reads its bubble's panel in a window over the bubble.
    """
    def key(b: dict) -> Column:
        return F.struct(b["y"].alias("y"), (-b["x"]).alias("left"), b["label"].alias("label"), (-b["confidence"]).alias("weak"),
                        b["region_id"].alias("region_id"))
    columns = ["region_id", *BOX, "label", "confidence"]
    nodes = predictions.select("image_id", *columns)
    pairs = grid.among(nodes, lambda a, b: (a["label"].isin("text", "bubble") & (b["label"] == "panel")) | ((a["label"] == "text") & (b["label"] == "bubble")))
    held = pairs.where((_area("a_") > 0) & (_c("inter") / _area("a_") >= 0.5))
    size = F.struct(_area("b_").alias("area"), _c("b_y").alias("y"), (-_c("b_x")).alias("x"), _c("b_region_id").alias("id"))
    rows = nodes.select("image_id", "region_id", "label", key({c: _c(c) for c in columns}).alias("key")).unionByName(held.select(
        "image_id", _c("a_region_id").alias("region_id"), _c("a_label").alias("label"), _c("b_label").alias("kind"), size.alias("size"),
        key({c: _c(f"b_{c}") for c in columns}).alias("box")), allowMissingColumns=True)
    home = lambda kind: F.min_by("box", F.when(_c("kind") == kind, _c("size"))).alias(kind)
    homed = (rows.repartition("image_id").groupBy("image_id", "region_id", "label").agg(F.collect_list("key").alias("keys"), home("bubble"), home("panel"))
             .withColumn("key", F.explode("keys")).drop("keys"))
    spoken = _c("bubble").isNotNull()
    around = Window.partitionBy("image_id", spoken | (_c("label") == "bubble"), F.coalesce("bubble.region_id", "region_id"))
    via = F.max(F.when(_c("label") == "bubble", _c("panel"))).over(around)
    topped = homed.withColumn("top", F.when(spoken, via).otherwise(_c("panel")))
    path = F.array_compact(F.array("top", "bubble", "key"))
    placed = topped.withColumn("preorder", F.row_number().over(Window.partitionBy("image_id").orderBy(path)).cast("bigint"))
    panel_id = F.coalesce("top.region_id", "panel.region_id")
    return placed.select("image_id", "region_id", "label", F.coalesce("bubble.region_id", panel_id).alias("parent_id"),
                         F.when(_c("label") == "text", panel_id).alias("text_panel_id"), "preorder")


def touches_balloon(texts: DataFrame, bubbles: DataFrame, share: float = 0.1) -> DataFrame:
    """Texts with more than ``share`` of their box over some balloon."""
    cols = ["image_id", "region_id", *BOX]
    pairs = grid.overlapping(texts.select(*cols), bubbles.select(*cols))
    hit = pairs.where(_c("inter") > _area("a_") * share).select("image_id", _c("a_region_id").alias("region_id"))
    return texts.join(hit, ["image_id", "region_id"], "left_semi")


def text_role(texts: DataFrame, assigned: DataFrame, touching: DataFrame, min_pixels: int = 24) -> DataFrame:
    """dialogue when in a balloon; free_text only when clear of every balloon and inked."""
    home = assigned.select("image_id", "region_id", "bubble_id")
    near = touching.select("image_id", "region_id", F.lit(True).alias("_near"))
    free = ((_c("label") != "onomatopoeia") & _c("_near").isNull() & (_c("mask_pixels") >= min_pixels))
    role = F.when(_c("bubble_id").isNotNull(), "dialogue").when(free, "free_text").otherwise("unknown")
    return (texts.drop("bubble_id").join(home, ["image_id", "region_id"], "left")
            .join(near, ["image_id", "region_id"], "left").withColumn("role", role).drop("_near"))


def panel_of_centre(regions: DataFrame, panels: DataFrame) -> DataFrame:
    """Regions whose centre lies in exactly one panel, with that panel."""
    points = regions.select("image_id", "region_id", (_c("x") + _c("w") / 2).alias("px"), (_c("y") + _c("h") / 2).alias("py"))
    return (grid.points_in_boxes(points, panels.select("image_id", "region_id", *BOX))
            .groupBy("image_id", "region_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("b_region_id").alias("panel_id"))
            .where("_n = 1").drop("_n"))
