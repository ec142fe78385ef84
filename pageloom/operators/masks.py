"""Exact mask algebra on run tables (image_id, mask_id, y, x0, x1), half-open runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.intervals import layers, merge_runs, stacked

_c = F.col
MASK = ["image_id", "mask_id"]
LINE = ["image_id", "mask_id", "y"]


def pixels() -> Column:
    return F.sum(_c("x1") - _c("x0"))


def boxes_to_runs(boxes: DataFrame, mask_id: str = "region_id", scale: int = 1) -> DataFrame:
    """One run per scan line of each box, on a grid reduced by ``scale``."""
    low = lambda v: F.floor(v / scale)
    return boxes.select(
        "image_id", _c(mask_id).alias("mask_id"),
        F.explode(F.sequence(low(_c("y")), F.greatest(low(_c("y")), low(_c("y") + _c("h")) - 1))).alias("y"),
        low(_c("x")).alias("x0"), F.greatest(low(_c("x")) + 1, low(_c("x") + _c("w"))).alias("x1"))


def rasterise(polygons: DataFrame, closed: bool = False, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Even-odd fill sampled at pixel centres of (keys..., polygon).

    ``closed`` also takes pixels whose centre lies on the outline (slack 1e-6).
    """
    line, ring = [*keys, "y"], _c("polygon")
    edge = (polygons.select(*keys, F.posexplode(F.arrays_zip(
        ring.alias("a"), F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)).alias("b"))).alias("side", "e"))
        .select(*keys, "side", _c("e.a.x").alias("ax"), _c("e.a.y").alias("ay"), _c("e.b.x").alias("bx"), _c("e.b.y").alias("by")))
    top, bottom = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.ceil(top - 0.5), F.ceil(bottom - 0.5) - 1
    crossing = (edge.where("ay <> by").where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
                .withColumn("at", _c("ax") + (_c("y") + 0.5 - _c("ay")) * (_c("bx") - _c("ax")) / (_c("by") - _c("ay"))))
    along = Window.partitionBy(*line).orderBy("at", "side")
    slack = 1e-6 if closed else 0.0
    stop = F.floor(_c("_next") - 0.5 + slack) + 1 if closed else F.ceil(_c("_next") - 0.5)
    runs = (crossing.withColumn("_n", F.row_number().over(along)).withColumn("_next", F.lead("at").over(along))
            .where("_n % 2 = 1 and _next is not null").select(*line, F.ceil(_c("at") - 0.5 - slack).alias("x0"), stop.alias("x1")))
    if closed:
        row = F.round(_c("ay") - 0.5).cast("bigint")
        flat = edge.where((F.abs(_c("ay") - _c("by")) <= slack) & (F.abs(_c("ay") - 0.5 - row) <= slack)).select(
            *keys, row.alias("y"), F.ceil(F.least("ax", "bx") - 0.5 - slack).alias("x0"),
            (F.floor(F.greatest("ax", "bx") - 0.5 + slack) + 1).alias("x1"))
        runs = runs.unionByName(flat)
    return merge_runs(runs, line)


def window(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs clipped to each mask's own box (floor of the low, ceiling of the high edges)."""
    edge = boxes.select(*MASK, F.floor("x").alias("_l"), F.ceil(_c("x") + _c("w")).alias("_r"),
                        F.floor("y").alias("_t"), F.ceil(_c("y") + _c("h")).alias("_b"))
    return (runs.join(edge, MASK).where((_c("y") >= _c("_t")) & (_c("y") < _c("_b")))
            .select(*LINE, F.greatest("x0", "_l").alias("x0"), F.least("x1", "_r").alias("x1")).where("x1 > x0"))


def area(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*MASK).agg(pixels().alias("area"))


def coverage(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Share of each inner mask under the union of the page's outer masks."""
    cover = merge_runs(outer, ["image_id", "y"])
    both = _overlap(inner, cover.withColumn("mask_id", F.lit(None)))
    hit = both.groupBy(*MASK).agg(F.sum("_shared").alias("covered"))
    return (area(inner).join(hit, MASK, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
            .withColumn("coverage", F.when(_c("area") > 0, _c("covered") / _c("area")).otherwise(0.0)))


def _overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlapping run pairs of two tables on one page line, with shared pixels."""
    right = b.select("image_id", "y", _c("mask_id").alias("other_id"), _c("x0").alias("_b0"), _c("x1").alias("_b1"))
    return (a.join(right, ["image_id", "y"]).where((_c("x0") < _c("_b1")) & (_c("_b0") < _c("x1")))
            .withColumn("_shared", F.least("x1", "_b1") - F.greatest("x0", "_b0")))


def pair_coverage(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(image_id, mask_id, other_id, shared): pixels each pair of masks has in common."""
    return _overlap(inner, outer).groupBy(*MASK, "other_id").agg(F.sum("_shared").alias("shared"))


def union(runs: DataFrame) -> DataFrame:
    """The page's combined mask."""
    return merge_runs(runs, ["image_id", "y"])


def dilate1(runs: DataFrame) -> DataFrame:
    """Grow by one pixel in all eight directions."""
    grown = runs.select(*MASK, F.explode(F.array(_c("y") - 1, _c("y"), _c("y") + 1)).alias("y"),
                        (_c("x0") - 1).alias("x0"), (_c("x1") + 1).alias("x1"))
    return merge_runs(grown, LINE)


def is_empty(masks: DataFrame, runs: DataFrame) -> DataFrame:
    """Masks with no file or no pixel."""
    return masks.join(runs.where("x1 > x0").select(*MASK), MASK, "left_anti")


def restore_area(removed: DataFrame, remaining: DataFrame) -> DataFrame:
    """Pixels of removed masks that no remaining mask claims."""
    return restored(stacked({"removed": removed, "remaining": remaining}))


def restored(runs: DataFrame) -> DataFrame:
    """``restore_area`` over one table whose ``layer`` is removed or remaining."""
    cut = layers(runs, ["removed", "remaining"], ["image_id", "y"])
    return merge_runs(cut.where("removed and not remaining").drop("removed", "remaining"), ["image_id", "y"])


def mask_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed pixels and their bounds per page."""
    return changed(stacked({"was": before, "is": after}))


def changed(runs: DataFrame) -> DataFrame:
    """``mask_change`` over one table whose ``layer`` is was or is."""
    cut = layers(runs, ["was", "is"], ["image_id", "y"]).where("was <> `is`")
    return cut.groupBy("image_id").agg(
        pixels().alias("changed"), F.min("x0").alias("left"), F.min("y").alias("top"),
        (F.max("x1") - F.min("x0")).alias("width"), (F.max("y") + 1 - F.min("y")).alias("height"))


def balloon_outside(masks: DataFrame, balloons: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pixels of each mask outside its own balloon; all of them when the balloon is absent."""
    pairs = pair_coverage(masks, balloons).join(
        assigned.select(*MASK, _c("bubble_id").alias("other_id")), [*MASK, "other_id"])
    return (area(masks).join(assigned.select(*MASK, "bubble_id"), MASK)
            .join(pairs.select(*MASK, "shared"), MASK, "left")
            .select(*MASK, "bubble_id", (_c("area") - F.coalesce("shared", F.lit(0))).alias("outside")))


def assign_balloon(texts: DataFrame, bubbles: DataFrame, share: float = 0.9) -> DataFrame:
    """The balloon of smallest mask holding ``share`` of each text mask."""
    sizes = area(bubbles).select("image_id", _c("mask_id").alias("other_id"), _c("area").alias("_size"))
    shared = (pair_coverage(texts, bubbles).join(area(texts), MASK)
              .withColumn("coverage", _c("shared") / F.greatest(F.lit(1), _c("area"))).where(_c("coverage") >= share)
              .join(sizes, ["image_id", "other_id"]))
    return shared.groupBy(*MASK).agg(F.min_by(F.struct(_c("other_id").alias("bubble_id"), "coverage"),
                                              F.struct("_size", "other_id")).alias("_b")).select(*MASK, "_b.*")


def fill_eligible(meta: DataFrame, version: int) -> DataFrame:
    """May the repaired area be filled with one flat colour?"""
    colour = F.forall("fill", lambda v: v.between(0, 255)) & (F.size("fill") == 3)
    trusted = _c("balloon_trusted") | _c("paper_verified")
    ok = ((_c("version") == version) & (_c("integrity") == "complete") & trusted & _c("uniform")
          & (_c("mask_sha") == _c("stored_sha")) & colour)
    return meta.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def oriented_frame(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """Padded box of each mask in axes turned by its angle, with pixel half-width.

    Only the two end pixels of a run can be extreme, so runs are never expanded.
    ``masks`` gives image_id, mask_id, angle, padding, width, height.
    """
    ends = runs.select(*LINE, F.explode(F.array(_c("x0"), _c("x1") - 1)).alias("px"))
    cos, sin = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    px, py = _c("px") + 0.5, _c("y") + 0.5
    u, v = px * cos + py * sin, py * cos - px * sin
    half = (F.abs(cos) + F.abs(sin)) / 2
    side = (ends.join(masks, MASK).groupBy(*MASK).agg(
        F.first("angle").alias("angle"), F.first("width").alias("width"), F.first("height").alias("height"),
        F.min(u - half - _c("padding")).alias("l"), F.max(u + half + _c("padding")).alias("r"),
        F.min(v - half - _c("padding")).alias("t"), F.max(v + half + _c("padding")).alias("b")))
    mid_u, mid_v = (_c("l") + _c("r")) / 2, (_c("t") + _c("b")) / 2
    w, h = _c("r") - _c("l"), _c("b") - _c("t")
    cx, cy = mid_u * cos - mid_v * sin, mid_u * sin + mid_v * cos
    ew, eh = (F.abs(cos) * w + F.abs(sin) * h) / 2, (F.abs(sin) * w + F.abs(cos) * h) / 2
    ok = ((F.least(w, h) >= 2) & (F.round(cx - ew, 6) >= 0) & (F.round(cy - eh, 6) >= 0)
          & (F.round(cx + ew, 6) <= _c("width")) & (F.round(cy + eh, 6) <= _c("height")))
    return side.select(*MASK, *[F.when(ok, F.round(e, 6)).alias(n) for n, e in
                                (("x", cx - w / 2), ("y", cy - h / 2), ("w", w), ("h", h))])


def run_digest(runs: DataFrame) -> DataFrame:
    """Content id of each mask: the first 20 hex of a digest over its maximal runs."""
    from pageloom.core.canon import multiset_digest
    line = F.sha2(F.concat_ws(",", "y", "x0", "x1"), 256)
    return merge_runs(runs, LINE).groupBy(*MASK).agg(
        F.substring(F.sha2(multiset_digest(line), 256), 1, 20).alias("instance_id"))


def dedupe_best(predictions: DataFrame, digests: DataFrame) -> DataFrame:
    """Of equal (label, mask) predictions keep the most confident; never drop text.

    Predictions with no pixels are equal only when their boxes are.
    """
    rank = F.struct((-_c("confidence")).alias("weak"), "y", (-_c("x")).alias("left"), "region_id")
    marked = predictions.join(digests.withColumnRenamed("mask_id", "region_id"), ["image_id", "region_id"], "left")
    same = F.coalesce("instance_id", F.concat_ws(",", F.lit("box"), "x", "y", "w", "h"))
    shapes = marked.where("label <> 'text'").withColumn("_same", same)
    best = shapes.groupBy("image_id", "label", "_same").agg(F.min_by("region_id", rank).alias("region_id"))
    kept = best.select("image_id", "region_id")
    return predictions.where("label = 'text'").unionByName(predictions.where("label <> 'text'").join(
        kept, ["image_id", "region_id"], "left_semi"))
