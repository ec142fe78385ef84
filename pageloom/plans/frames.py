"""J-04 and R-25 bound to the given tables: overlaps of turned and dented frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.operators import quality as Q
from pageloom.operators.frames import frame_overlap_join
from pageloom.plans.registry import query

_c = F.col
# Frame pairs measured between all heights where corners lie or edges meet.
FRAMES_SQL = """
  shown as (select image_id, region_id, reading_order as seq, x, y, w, h, rotation, font_size % 5 = 0 as dented from text_regions where visible and trim(translated_text) <> ''),
  corner as (
    select s.*, k, case k when 0 then x when 3 then x when 4 then x + w / 2 else x + w end as u, case k when 0 then y when 1 then y when 4 then y + h / 2 else y + h end as v,
      case k when 0 then 0 when 1 then 1 when 4 then 2 when 2 then 3 else 4 end as place
    from shown s, (select unnest([0, 1, 2, 3, 4]) as k) where k < 4 or dented),
  spun as (
    select image_id, region_id, seq, place, case when dented then u else x + w / 2 + (u - x - w / 2) * cos(radians(rotation)) - (v - y - h / 2) * sin(radians(rotation)) end as px,
      case when dented then v else y + h / 2 + (u - x - w / 2) * sin(radians(rotation)) + (v - y - h / 2) * cos(radians(rotation)) end as qy from corner),
  side as (
    select *, coalesce(lead(px) over o, first_value(px) over o) as ex, coalesce(lead(qy) over o, first_value(qy) over o) as ey from spun
    window o as (partition by image_id, region_id order by place rows between unbounded preceding and unbounded following)),
  extent as (select image_id, region_id, seq, min(px) l, max(px) r, min(qy) t, max(qy) b from spun group by all),
  pair as (
    select a.image_id, a.region_id as first_id, b.region_id as second_id from extent a join extent b on a.image_id = b.image_id
      and (a.seq, a.region_id) < (b.seq, b.region_id) and a.l < b.r and b.l < a.r and a.t < b.b and b.t < a.b),
  both_sides as (
    select p.*, 0 as who, px, qy, ex, ey from pair p join side s on p.image_id = s.image_id and first_id = s.region_id
    union all select p.*, 1, px, qy, ex, ey from pair p join side s on p.image_id = s.image_id and second_id = s.region_id),
  meet as (
    select image_id, first_id, second_id, ay + m * dy as y from (
      select a.image_id, a.first_id, a.second_id, a.qy as ay, a.ey - a.qy as dy, (a.ex - a.px) * (b.ey - b.qy) - (a.ey - a.qy) * (b.ex - b.px) as d,
        case when d <> 0 then ((b.px - a.px) * (b.ey - b.qy) - (b.qy - a.qy) * (b.ex - b.px)) / d end as m,
        case when d <> 0 then ((b.px - a.px) * (a.ey - a.qy) - (b.qy - a.qy) * (a.ex - a.px)) / d end as n
      from both_sides a join both_sides b using (image_id, first_id, second_id)) where m between 0 and 1 and n between 0 and 1),
  height as (select distinct * from (select * from meet union all select image_id, first_id, second_id, qy from both_sides)),
  strip as (select image_id, first_id, second_id, y as low, lead(y) over (partition by image_id, first_id, second_id order by y) as high from height),
  hit as (
    select *, row_number() over (partition by image_id, first_id, second_id, low, who order by pos) as n from (
      select image_id, first_id, second_id, low, high, who, px + ((low + high) / 2 - qy) * (ex - px) / (ey - qy) as pos
      from strip join both_sides using (image_id, first_id, second_id)
      where high is not null and (qy > (low + high) / 2) <> (ey > (low + high) / 2))),
  span as (
    select a.image_id, a.first_id, a.second_id, a.low, a.high, a.who, a.pos as l, b.pos as r from hit a join hit b
      using (image_id, first_id, second_id, low, who) where a.n % 2 = 1 and b.n = a.n + 1),
  own_area as (select image_id, first_id, second_id, who, sum((r - l) * (high - low)) as area from span group by all),
  common as (
    select a.image_id, a.first_id, a.second_id, sum(greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * (a.high - a.low)) as area
    from span a join span b using (image_id, first_id, second_id, low) where a.who = 0 and b.who = 1 group by all),
  frame_pair as (
    select c.image_id, c.first_id, c.second_id, round(c.area / greatest(1, least(f.area, g.area)), 9) as ratio
    from common c join own_area f on f.who = 0 and (c.image_id, c.first_id, c.second_id) = (f.image_id, f.first_id, f.second_id)
      join own_area g on g.who = 1 and (c.image_id, c.first_id, c.second_id) = (g.image_id, g.first_id, g.second_id))"""
FRAME_ISSUES_SQL = f"""select project_id, image_id, first_id as region_id, 'translation_overlap' as code, 'warning' as severity
  from (with {FRAMES_SQL} select * from frame_pair where ratio > 0.12) join image_pages using (image_id)"""


@query("j04_frame_overlap_join", f"with {FRAMES_SQL} select image_id, first_id, second_id, round(ratio, 6) as ratio from frame_pair where ratio > 0.12")
def _j04(t):
    return frame_overlap_join(text_frames(t)).withColumn("ratio", F.round("ratio", 6))


@query("r25_translation_overlap", FRAME_ISSUES_SQL)
def _r25(t):
    return Q.with_project(Q.frame_findings(text_frames(t)), t.image_pages)


def text_frames(t):
    """Rotated quads of the shown translations; every fifth one is dented."""
    r = t.text_regions.where("visible and trim(translated_text) <> ''")
    x, y, w, h = _c("x"), _c("y"), _c("w"), _c("h")
    quad = G.box_to_polygon(x, y, w, h)
    dent = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w / 2, y + h / 2), G.point(x + w, y + h), G.point(x, y + h))
    turned = G.rotate_polygon(quad, x + w / 2, y + h / 2, _c("rotation").cast("double"))
    return r.select("image_id", "region_id", _c("reading_order").alias("seq"), F.when(_c("font_size") % 5 == 0, dent).otherwise(turned).alias("polygon"))
