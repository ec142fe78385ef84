"""Overlap of translated frames of any simple outline, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.core import grid
from pageloom.functions import geometry as G

_c = F.col
#: Ratios are compared at nine digits, so that turned frames do not hang on the last bit of a sine.
DIGITS = 9


def frame_overlap_join(frames: DataFrame, share: float = 0.12) -> DataFrame:
    """Frame pairs on a page whose overlap exceeds ``share`` of the smaller frame.

    ``frames``: image_id, region_id, seq, polygon.  Bounding boxes meet
    first; only pairs whose boxes share enough reach the polygon
    test, dealt evenly, as it is what costs most.
    """
    boxed = frames.withColumn("_b", F.explode(F.array(G.polygon_to_box(_c("polygon"))))).select(
        "image_id", "region_id", "seq", "_b.*", "polygon", G.polygon_area(_c("polygon")).alias("area"))
    smaller = F.greatest(F.lit(1.0), F.least("a_area", "b_area"))
    rank = lambda k: F.struct(k["seq"].alias("seq"), k["region_id"].alias("id"))
    pairs = grid.among(boxed, lambda a, b: rank(a) < rank(b))
    pairs = pairs.where(_c("inter") > smaller * (share - 1e-6)).select(
        "image_id", _c("a_region_id").alias("first_id"), _c("b_region_id").alias("second_id"), "a_polygon", "b_polygon")
    dealt = pairs.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    areas = dealt.select("image_id", "first_id", "second_id", F.explode(F.array(G.shared_areas(_c("a_polygon"), _c("b_polygon")))).alias("_s"))
    ratio = F.round(_c("_s.both") / F.greatest(F.lit(1.0), F.least("_s.first", "_s.second")), DIGITS)
    return areas.select("image_id", "first_id", "second_id", ratio.alias("ratio")).where(_c("ratio") > share)
