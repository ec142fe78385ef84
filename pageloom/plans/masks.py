"""M-01..M-21 and the component checks bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.core.dealing import dealt
from pageloom.functions import geometry as G
from pageloom.operators import components as C
from pageloom.operators import masks as M
from pageloom.plans.joins import RUNS, _ASSIGN, _assigned, _runs
from pageloom.plans.registry import query

_c = F.col


def sheared(t):
    """A quadrilateral per region, sheared by its text size."""
    r, d = t.text_regions, _c("font_size") / 2.0
    return r.select("image_id", _c("region_id").alias("mask_id"), F.array(
        G.point(_c("x") / 10, _c("y") / 10), G.point((_c("x") + _c("w")) / 10, _c("y") / 10 + d / 4),
        G.point((_c("x") + _c("w")) / 10 + d, (_c("y") + _c("h")) / 10), G.point(_c("x") / 10 + d, (_c("y") + _c("h")) / 10 - d / 8)).alias("polygon"))


_SHEAR = """v as (select image_id, region_id as mask_id, font_size / 2.0 d, x / 10 as x0, (x + w) / 10 as x1, y / 10 as y0, (y + h) / 10 as y1 from text_regions),
  ed as (select image_id, mask_id, 0 s, x0 ax, y0 ay, x1 bx, y0 + d / 4 as qy from v union all select image_id, mask_id, 1, x1, y0 + d / 4, x1 + d, y1 from v
    union all select image_id, mask_id, 2, x1 + d, y1, x0 + d, y1 - d / 8 from v union all select image_id, mask_id, 3, x0 + d, y1 - d / 8, x0, y0 from v),
  cr as (select image_id, mask_id, s, y, ax + (y + 0.5 - ay) * (bx - ax) / (qy - ay) as p from (select *, unnest(generate_series(cast(ceil(least(ay, qy) - 0.5) as bigint),
    cast(ceil(greatest(ay, qy) - 0.5) as bigint) - 1)) y from ed where ay <> qy)),
  pr as (select *, row_number() over o n, lead(p) over o q from cr window o as (partition by image_id, mask_id, y order by p, s)),
  rs as (select image_id, mask_id, y, cast(ceil(p - 0.5) as bigint) x0, cast(ceil(q - 0.5) as bigint) x1 from pr where n % 2 = 1 and q is not null)"""
# Merge runs of each key; touching runs join.
_MERGE = lambda src, keys, out: f"""{out}_d as (select {keys}, x0, max(x1) x1 from {src} where x1 > x0 group by {keys}, x0),
  {out}_m as (select *, max(x1) over (partition by {keys} order by x0 rows between unbounded preceding and 1 preceding) mx from {out}_d),
  {out}_i as (select *, sum(case when x0 <= mx then 0 else 1 end) over (partition by {keys} order by x0 rows unbounded preceding) i from {out}_m),
  {out} as (select {keys}, min(x0) as x0, max(x1) as x1 from {out}_i group by {keys}, i)"""  # noqa: E731
_KEYS = "image_id, mask_id, y"


@query("m01_rasterise", f"with {_SHEAR}, {_MERGE('rs', _KEYS, 'out')} select * from out")
def _m01(t):
    return M.rasterise(dealt(sheared(t), "image_id", "mask_id"))


@query("m02_window", f"""with {RUNS('rr', 'text_regions')}, b as (select image_id, region_id mask_id, x / 10 + 1.5 as bx, y / 10 + 0.5 as qy, w / 20 as bw, h / 20 as bh from text_regions)
  select image_id, mask_id, y, greatest(x0, cast(floor(bx) as bigint)) as x0, least(x1, cast(ceil(bx + bw) as bigint)) as x1 from rr join b using (image_id, mask_id)
  where y >= floor(qy) and y < ceil(qy + bh) and least(x1, cast(ceil(bx + bw) as bigint)) > greatest(x0, cast(floor(bx) as bigint))""")
def _m02(t):
    boxes = t.text_regions.selectExpr("image_id", "region_id as mask_id", "x / 10 + 1.5 as x", "y / 10 + 0.5 as y", "w / 20 as w", "h / 20 as h")
    return M.window(_runs(t.text_regions), boxes)


@query("m03_coverage", f"""with {RUNS('a', 'lettering')}, {RUNS('o', 'bubbles')}, {_MERGE('o', 'image_id, y', 'u')},
  n as (select image_id, mask_id, sum(x1 - x0) ar from a group by 1, 2),
  h as (select a.image_id, a.mask_id, sum(least(a.x1, u.x1) - greatest(a.x0, u.x0)) c from a join u on a.image_id = u.image_id and a.y = u.y and a.x0 < u.x1 and u.x0 < a.x1 group by 1, 2)
  select image_id, mask_id, cast(ar as bigint) as area, cast(coalesce(c, 0) as bigint) as covered, round(coalesce(c, 0) * 1.0 / ar, 6) as coverage from n left join h using (image_id, mask_id)""")
def _m03(t):
    return M.coverage(_runs(t.lettering), _runs(t.bubbles)).select(
        "image_id", "mask_id", "area", _c("covered").cast("bigint").alias("covered"), F.round("coverage", 6).alias("coverage"))


@query("m04_union", f"with {RUNS('a', 'text_regions')}, {_MERGE('a', 'image_id, y', 'u')} select * from u")
def _m04(t):
    return M.union(_runs(t.text_regions, "image_id"))


@query("m05_dilate1", f"""with {RUNS('a', 'lettering')}, g as (select image_id, mask_id, y + d as y, x0 - 1 as x0, x1 + 1 as x1 from a, (values (-1), (0), (1)) v(d)),
  {_MERGE('g', _KEYS, 'u')} select * from u""")
def _m05(t):
    return M.dilate1(_runs(t.lettering))


@query("m06_components")
def _m06(t):
    # Each page's lettering as one mask, so that boxes touch and merge.
    return C.component_boxes(C.components(_page_mask(t)))


def _page_mask(t, where="true"):
    return _runs(t.text_regions.where(where), "image_id").withColumn("mask_id", _c("image_id"))


def _twice(runs, first, second, where, x1=None):
    """One table of two layers: all runs, and once more those of ``where`` (with another end, if given)."""
    layer = lambda name, end: F.struct(F.lit(name).alias("layer"), end.alias("x1"))
    once = layer(first, _c("x1"))
    return runs.withColumn("_l", F.explode(F.when(F.expr(where), F.array(once, layer(second, _c("x1") if x1 is None else x1))).otherwise(F.array(once)))
                           ).select("image_id", "mask_id", "y", "x0", "_l.x1", "_l.layer")


def _marked(boxes, mark):
    """Scan lines of page masks with a ``mark`` of the box they come from."""
    return M.boxes_to_runs(dealt(boxes.withColumn("_id", F.struct("region_id", F.expr(mark).alias("mark"))), "image_id"), "_id", 10).select(
        "image_id", _c("image_id").alias("mask_id"), "y", "x0", "x1", _c("mask_id.mark").alias("mark"))


def _frames(t):
    """Two frames per page mask: the left and the right part of the page."""
    box = lambda n, x, w: F.struct(F.lit(n).alias("frame_id"), G.box_to_polygon(F.lit(x), F.lit(-1), F.lit(w), F.lit(200)).alias("polygon"))
    return t.image_pages.select("image_id", _c("image_id").alias("mask_id"), F.explode(F.array(box(0, -1, 41), box(1, 35, 90))).alias("f")).select(
        "image_id", "mask_id", "f.*")


@query("m07_covered_components")
def _m07(t):
    return C.covered_components(_page_mask(t), _frames(t))


@query("m08_components_supported")
def _m08(t):
    return C.components_supported(_runs(t.lettering, "image_id"), _runs(t.bubbles, "image_id"))


@query("m09_is_empty", "select image_id, region_id as mask_id from text_regions where coalesce(mask_pixels, 0) = 0")
def _m09(t):
    r = t.text_regions
    return M.is_empty(r.selectExpr("image_id", "region_id as mask_id"), _runs(r.where("mask_pixels > 0")))


@query("m10_frames_cover", f"""with {RUNS('a', 'text_regions')} select image_id, image_id as mask_id,
    bool_and((x0 >= -1 and x1 - 0.5 <= 40) or (x0 + 0.5 >= 35 and x1 <= 125) or (x0 + 0.5 <= 40 and x1 - 0.5 >= 35 and x1 <= 125)) as covered from a group by 1""")
def _m10(t):
    return C.frames_cover(_page_mask(t), _frames(t))


@query("m14_restore_area", f"""
  with {RUNS('a', 'lettering')}, k as (select *, hash_side from (select a.*, l.confidence < 0.3 as hash_side from a join lettering l on a.image_id = l.image_id and a.mask_id = l.region_id)),
  px as (select distinct image_id, y, unnest(generate_series(x0, x1 - 1)) x from k where hash_side),
  qx as (select distinct image_id, y, unnest(generate_series(x0, x1 - 1)) x from k where not hash_side),
  d as (select * from px except select * from qx), i as (select *, x - row_number() over (partition by image_id, y order by x) g from d)
  select image_id, y, min(x) as x0, max(x) + 1 as x1 from i group by image_id, y, g""")
def _m14(t):
    side = "case when confidence < 0.3 then 'removed' when not confidence < 0.3 then 'remaining' end"
    return M.restored(_marked(t.lettering, side).withColumnRenamed("mark", "layer"))


@query("m16_mask_change", f"""
  with {RUNS('a', 'text_regions')}, b as (select * from a), l as (select image_id, y, x0, x1 + mask_id % 2 as x1 from a where mask_id % 5 <> 0),
  px as (select distinct image_id, y, unnest(generate_series(x0, x1 - 1)) x from b), qx as (select distinct image_id, y, unnest(generate_series(x0, x1 - 1)) x from l),
  d as ((select * from px except select * from qx) union all (select * from qx except select * from px))
  select image_id, count(*) as changed, min(x) as "left", min(y) as top, max(x) + 1 - min(x) as width, max(y) + 1 - min(y) as height from d group by 1""")
def _m16(t):
    return M.changed(_twice(_runs(t.text_regions, "image_id"), "was", "is", "mask_id % 5 <> 0", _c("x1") + _c("mask_id") % 2))


@query("m17_fill_eligible", """select image_id, region_id, mask_integrity = 'complete' and (font_size % 2 = 0 or font_size % 3 = 0) and font_size < 22
  and not overflow and x % 300 <= 255 and font_size % 4 <> 1 as eligible from text_regions""")
def _m17(t):
    meta = t.text_regions.select(
        "image_id", "region_id", F.when(_c("font_size") < 22, 3).otherwise(2).alias("version"), _c("mask_integrity").alias("integrity"),
        (_c("font_size") % 2 == 0).alias("balloon_trusted"), (_c("font_size") % 3 == 0).alias("paper_verified"), (~_c("overflow")).alias("uniform"),
        F.lit("a").alias("mask_sha"), F.when(_c("font_size") % 4 == 1, "b").otherwise("a").alias("stored_sha"),
        F.array(_c("x") % 300, F.lit(10), F.lit(20)).alias("fill"))
    return M.fill_eligible(meta, 3).select("image_id", "region_id", "eligible")


@query("m18_balloon_outside", f"""with {_ASSIGN}, o as (select asg.image_id, asg.mask_id, bubble_id, ta.area, coalesce(sh.n, 0) n from asg
    join ta using (image_id, mask_id) left join sh on asg.image_id = sh.image_id and asg.mask_id = sh.mask_id and asg.bubble_id = sh.other)
  select image_id, mask_id, bubble_id, cast(area - n as bigint) as outside from o""")
def _m18(t):
    return M.balloon_outside(_runs(t.lettering), _runs(t.bubbles), _assigned(t))


@query("m19_oriented_frame", f"""
  with {RUNS('a', 'lettering')}, p as (select a.*, 15.0 * (mask_id % 4) - 15 as ang, e0 + 0.5 as px, y + 0.5 as py from (select *, unnest([x0, x1 - 1]) as e0 from a) a),
  r as (select image_id, mask_id, ang, min(px * cos(radians(ang)) + py * sin(radians(ang))) ul, max(px * cos(radians(ang)) + py * sin(radians(ang))) uh,
    min(py * cos(radians(ang)) - px * sin(radians(ang))) vl, max(py * cos(radians(ang)) - px * sin(radians(ang))) vh from p group by 1, 2, 3),
  e as (select *, (abs(cos(radians(ang))) + abs(sin(radians(ang)))) / 2 + 2 as m from r),
  f as (select image_id, mask_id, ang, ul - m as l, uh + m as rr, vl - m as t, vh + m as b from e),
  c as (select *, (l + rr) / 2 * cos(radians(ang)) - (t + b) / 2 * sin(radians(ang)) cx, (l + rr) / 2 * sin(radians(ang)) + (t + b) / 2 * cos(radians(ang)) cy,
    rr - l as w, b - t as h from f),
  g as (select *, (abs(cos(radians(ang))) * w + abs(sin(radians(ang))) * h) / 2 ew, (abs(sin(radians(ang))) * w + abs(cos(radians(ang))) * h) / 2 eh from c),
  k as (select *, least(w, h) >= 2 and round(cx - ew, 6) >= 0 and round(cy - eh, 6) >= 0 and round(cx + ew, 6) <= 100 and round(cy + eh, 6) <= 140 ok from g)
  select image_id, mask_id, case when ok then round(cx - w / 2, 6) end as x, case when ok then round(cy - h / 2, 6) end as y,
    case when ok then round(w, 6) end as w, case when ok then round(h, 6) end as h from k""")
def _m19(t):
    meta = t.lettering.select("image_id", _c("region_id").alias("mask_id"), (F.lit(15.0) * (_c("region_id") % 4) - 15).alias("angle"),
                              F.lit(2.0).alias("padding"), F.lit(100).alias("width"), F.lit(140).alias("height"))
    return M.oriented_frame(_runs(t.lettering), meta)


@query("m20_instance_id")
def _m20(t):
    return M.run_digest(_runs(t.text_regions))


def _pixels(t):
    """A probability map per embedding: 64 values on an 8 by 8 grid."""
    v = F.abs(_c("v").cast("double")) * 6
    return t.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        _c("vec_id").alias("image_id"), _c("vec_id").alias("mask_id"), F.floor(_c("p") / 8).alias("y"), (_c("p") % 8).cast("bigint").alias("x"),
        v.alias("after"), (v * 0.8).alias("before"), (_c("p") % 11 != 0).alias("allowed"))


@query("m15_residual")
def _m15(t):
    return C.residual(_pixels(t))


@query("m21_coherent_components")
def _m21(t):
    return C.coherent(_twice(_marked(t.text_regions, "font_size % 4 = 0"), "candidate", "support", "mark"))


@query("a15_glyph_integrity")
def _a15(t):
    return C.integrity(_twice(_marked(t.text_regions, "font_size % 5 <> 0"), "evidence", "kept", "mark"))


@query("a29_text_line_stats", f"""
  with {RUNS('a', 'text_regions')}, {_MERGE('a', 'image_id, y', 'u')},
  ln as (select image_id, y, sum(x1 - x0) ink from u group by 1, 2), z as (select image_id, y - row_number() over (partition by image_id order by y) i, y from ln where ink >= 3),
  b as (select image_id, min(y) a, max(y) + 1 b from z group by image_id, i), g as (select *, b - a h, a - lag(b) over (partition by image_id order by a) gap from b),
  s as (select image_id, count(*) bands, median(h) height, min(h) lo, max(h) hi, min(gap) min_gap, median(gap) gap from g group by 1),
  d as (select image_id, cast(sum(ink) as double) / 14000 density from ln group by 1)
  select image_id, image_id as mask_id, bands, height, min_gap, gap, round(density, 6) as density,
    coalesce(bands between 6 and 80 and height >= 3 and lo >= height * 0.5 and hi <= height * 1.6 and min_gap >= greatest(2.0, height * 0.25)
      and gap <= height * 2 and density > 0.03 and density < 0.65, false) as accepted from s join d using (image_id)""")
def _a29(t):
    page = M.merge_runs(_page_mask(t), M.LINE)
    boxes = t.image_pages.select("image_id", _c("image_id").alias("mask_id"), F.lit(100).alias("w"), F.lit(140).alias("h"))
    return C.text_line_stats(page, boxes).withColumn("density", F.round("density", 6))


@query("a32_mask_parity")
def _a32(t):
    return C.parity(_twice(_runs(t.text_regions, "image_id"), "old", "new", "mask_id % 50 <> 0 or y % 2 = 0"))


@query("a22_angle_search")
def _a22(t):
    from pageloom.operators.angles import angle_search
    # Ink points of each page: the corners of its lettering boxes.
    corners = F.posexplode(G.box_to_polygon(_c("x") / 4, _c("y") / 4, _c("w") / 4, _c("h") / 4)).alias("corner", "p")
    return angle_search(dealt(t.lettering.select("image_id", "x", "y", "w", "h"), "image_id").select("image_id", corners).select(
        "image_id", _c("p.x").alias("px"), _c("p.y").alias("py")), "image_id")
