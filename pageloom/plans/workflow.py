"""T-01..T-06 and X-01..X-07 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.core.dealing import dealt
from pageloom.operators import masks as M
from pageloom.operators import ordering as O  # noqa: F401
from pageloom.operators import workflow as K
from pageloom.plans.filters import _typed, _TYPED, _FULL
from pageloom.plans.joins import _runs, RUNS
from pageloom.plans.registry import query

_c = F.col


@query("t01_spatial_sort", "select image_id, region_id, x, y, label from text_regions")
def _t01(t):
    return K.spatial_sort(t.text_regions.select("image_id", "region_id", "x", "y", "label"))


@query("t02_paginate", """select project_id, name, cast(case when count(*) over () > 200 then 200 end as bigint) as next_offset
  from projects order by updated_us desc, project_id limit 150 offset 50""")
def _t02(t):
    return K.paginate(t.projects, [F.desc("updated_us"), _c("project_id")], 150, 50).select("project_id", "name", "next_offset")


@query("t03_focus_windows")
def _t03(t):
    boxes = dealt(t.text_regions.select("image_id", "x", "y", "w", "h"), "image_id")
    boxes = boxes.join(t.image_pages.select("image_id", "width", "height"), "image_id").select("image_id", *[_c(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "width", "height")
    return K.focus_windows(boxes)


# Review evidence: the page's boxes, enlarged, at a scale that varies.
_EV = "select image_id, x, y, w * 3 as w, h * 5 as h, reading_order % 4 as scale from text_regions"


@query("t04_review_tiles", f"""
  with ev as ({_EV}), f as (select image_id, min(greatest(1, cast(ceil(greatest(w, h) / 2) as bigint))) half from ev where scale > 2 group by 1),
  g as (select p.image_id, width, height, least(1600, coalesce(half, 1600)) side from image_pages p left join f using (image_id)),
  s as (select *, greatest(1, side - side // 10) step from g),
  n as (select *, greatest(1, cast(ceil(greatest(0, width - side) / step) as bigint) + 1) nc, greatest(1, cast(ceil(greatest(0, height - side) / step) as bigint) + 1) nr from s),
  t as (select image_id, least(i * step, greatest(0, width - side)) tx, least(j * step, greatest(0, height - side)) ty, side, width, height
    from (select *, unnest(generate_series(0, nc - 1)) i from (select *, unnest(generate_series(0, nr - 1)) j from n where nc * nr <= 256))),
  tl as (select image_id, tx, ty, least(side, width - tx) tw, least(side, height - ty) th from t),
  cl as (select t.image_id, tx, ty, greatest(x, tx) x, greatest(y, ty) y, least(x + w, tx + tw) - greatest(x, tx) w, least(y + h, ty + th) - greatest(y, ty) h
    from tl t join ev e on t.image_id = e.image_id and scale <= 2 and least(x + w, tx + tw) > greatest(x, tx) and least(y + h, ty + th) > greatest(y, ty)),
  e as (select distinct image_id, tx, ty, unnest([x, x + w]) p from cl),
  sl as (select image_id, tx, ty, p as l, lead(p) over (partition by image_id, tx, ty order by p) r from e),
  c as (select sl.*, y y0, y + h y1 from sl join cl q using (image_id, tx, ty) where r is not null and q.x <= l and q.x + q.w >= r),
  m as (select *, max(y1) over (partition by image_id, tx, ty, l order by y0, y1 rows between unbounded preceding and 1 preceding) reach from c),
  u as (select image_id, tx, ty, sum((r - l) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) area from m group by all)
  select tl.image_id, tl.tx, tl.ty, tw, th, false as blocked from tl left join u on tl.image_id = u.image_id and tl.tx = u.tx and tl.ty = u.ty
  where coalesce(area, 0) < tw * th
  union all select image_id, null, null, null, null, true from n where nc * nr > 256""")
def _t04(t):
    ev = t.text_regions.selectExpr("image_id", "x", "y", "w * 3 as w", "h * 5 as h", "reading_order % 4 as scale")
    return K.review_tiles(t.image_pages, dealt(ev, "image_id"))


_FACTS = {
    "page_missing": "image_id % 97 = 0", "configuration_stale": "run_id % 41 = 0", "has_active": "image_id % 9 = 0",
    "has_paused": "image_id % 18 = 0", "final_present": "outcome is not null", "final_current": "outcome is not null and reviewed_version = current_version",
    "final_outcome": "outcome", "final_deliver": "deliver_with_issues", "correction_open": "correction_open", "rounds": "image_id % 4",
    "latest_status": "case image_id % 13 when 0 then 'FAILED' when 1 then 'CANCELLED' else 'COMPLETED' end", "batch": "run_id % 2 = 0",
    "problem_review_current": "image_id % 5 = 0", "rendered_current": "image_id % 3 = 0", "stale_translation": "image_id % 7 = 0",
    "repair_ready": "image_id % 2 = 0", "preflight_at_version": "image_id % 5 < 3", "preflight_outcome":
    "case image_id % 6 when 0 then 'issues' when 1 then 'unverified' when 2 then null else 'passed' end",
    "text_start": "case image_id % 11 when 0 then 'detection' when 1 then 'ocr' when 2 then 'translation' end", "agent_mode": "run_id % 3 = 0",
    "untranslated": "image_id % 4 = 1", "text_checked": "image_id % 8 > 1", "row_count": "image_id % 10", "detection_done": "image_id % 20 > 3",
    "preflight_current": "image_id % 7 > 1", "layout_only": "image_id % 14 = 0", "missing_ocr": "image_id % 2 = 1", "restores": "image_id % 17 = 0",
    "pending_repair": "image_id % 19 = 0", "selected": "image_id % 23", "mask_missing": "image_id % 29 = 0", "clean_present": "image_id % 31 <> 0"}
_FACT_LIST = ", ".join(f"{e} as {n}" for n, e in _FACTS.items())
_STAGED = f"""f as (select run_id, image_id, {_FACT_LIST} from review_pages),
  st as (select *, case when page_missing then 'page_deleted' when configuration_stale then 'configuration_changed'
    when has_active then case when has_paused then 'paused' else 'waiting' end
    when final_current and not correction_open then
      case when final_outcome = 'issues' and not final_deliver and rounds < 2 then 'correction_available'
           when final_outcome = 'issues' and not final_deliver and batch then 'delivery_decision' else 'ready_for_delivery' end
    when latest_status in ('FAILED', 'CANCELLED') then lower(latest_status)
    when batch and correction_open and problem_review_current then 'correcting'
    when rendered_current and not stale_translation and repair_ready then 'final_review'
    when final_present and not correction_open then case when rounds < 2 and preflight_at_version and preflight_outcome = 'issues' then 'correction_available' else 'stale_review' end
    when batch and text_start is not null then text_start
    when batch and agent_mode and untranslated then 'agent_translation'
    when batch and not text_checked then 'preflight_review'
    when batch and coalesce(preflight_outcome, '') <> 'passed' then case when correction_open then 'preflight_review' when rounds < 2 then 'correction_available' else 'preflight_unresolved' end
    when row_count = 0 and not detection_done then 'detection'
    when not preflight_current then case when layout_only then 'rendering' when missing_ocr then 'ocr' else 'preflight_review' end
    when restores and not pending_repair then 'inpainting' when selected = 0 then 'rendering'
    when untranslated then case when agent_mode then 'agent_translation' else 'translation' end
    when mask_missing then 'mask' when not clean_present or pending_repair then 'inpainting' else 'rendering' end as stage from f)"""


def staged(t):
    facts = t.review_pages.selectExpr("run_id", "image_id", "lease_expires_us", *[f"{e} as {n}" for n, e in _FACTS.items()])
    return K.page_stage(facts)


@query("t05_page_stage", f"with {_STAGED} select run_id, image_id, stage from st")
def _t05(t):
    return staged(t).select("run_id", "image_id", "stage")


@query("t05_next_action", f"""
  with {_STAGED}, k as (select *, case when stage in ('detection','ocr','translation','mask','inpainting','rendering') then
      case when text_start is not null then 'text' else 'output' end
      when stage in ('preflight_review','final_review','stale_review','delivery_decision') then 'review' when stage = 'correction_available' then 'correction'
      when stage = 'agent_translation' then 'agent' when stage = 'correcting' then 'editing' end kind, run_id % 5 = 0 as started, run_id % 4 <> 0 as initial from st),
  r as (select run_id, bool_or(has_active) act, bool_or(coalesce(kind in ('text', 'agent'), false) or has_active) texty from k group by 1),
  p as (select k.*, case when kind = 'text' then 1 when kind = 'agent' then 2 when kind = 'output' and started then 3 when kind = 'review' then 4
      when kind = 'editing' and not act then 5 when kind = 'correction' and not act then 6 when kind = 'output' and not (initial and texty) then 7
      when stage <> 'ready_for_delivery' then 8 end priority from k join r using (run_id)),
  b as (select *, min(priority) over (partition by run_id) best from p where priority is not null),
  n as (select *, row_number() over (partition by run_id order by image_id) place from b where priority = best)
  select run_id, image_id, stage, cast(priority as integer) as priority, cast(place as integer) as place from n
  where place <= 20 and (kind in ('text', 'output') or place = 1)""")
def _t05b(t):
    s = staged(t).withColumn("order_index", _c("image_id")).withColumn("text_only", _c("text_start").isNotNull()).withColumn(
        "output_started", _c("run_id") % 5 == 0).withColumn("initial_phase", _c("run_id") % 4 != 0)
    return K.next_action(s)


@query("a33_coordination_counts", f"""
  with {_STAGED}, j as (select st.run_id, st.stage, lease_expires_us > 899000000000000 as live, st.image_id % 2 = 0 as allowed from st join review_pages using (image_id)),
  q as (select *, stage in ('preflight_review', 'final_review', 'stale_review', 'delivery_decision', 'preflight_unresolved', 'failed', 'cancelled')
    or (stage in ('correction_available', 'correcting') and allowed) as ready from j)
  select run_id, count(*) filter (not live and ready) as claimable, count(*) filter (live) as claimed,
    count(*) filter (stage in ('waiting', 'paused')) as waiting, count(*) filter (stage in ('correction_available', 'correcting')) as correction_pending
  from q group by 1""")
def _a33(t):
    from pageloom.operators import telemetry
    from pageloom.plans.filters import NOW_US
    return telemetry.coordination_counts(staged(t).withColumn("allowed", _c("image_id") % 2 == 0), NOW_US)


@query("t06_dedupe_best", f"""
  with r as (select image_id, region_id, case when label = 'text' and font_size % 3 <> 0 then 'text' else 'bubble' end as label, x // 100 * 100 as x, y // 100 * 100 as y,
     cast(200 as bigint) w, cast(100 as bigint) h, confidence from text_regions)
  select image_id, region_id, label from r where label = 'text' union all
  select image_id, arg_min(region_id, row(-confidence, y, -x, region_id)), label from r where label <> 'text' group by image_id, label, x, y""")
def _t06(t):
    r = t.text_regions.selectExpr("image_id", "region_id", "case when label = 'text' and font_size % 3 <> 0 then 'text' else 'bubble' end as label",
                                  "x div 100 * 100 as x", "y div 100 * 100 as y", "cast(200 as bigint) as w", "cast(100 as bigint) as h", "confidence")
    return M.dedupe_best(r, M.run_digest(_runs(r.where("label <> 'text'")))).select("image_id", "region_id", "label")


@query("x01_suppress", """
  with r as (select * from text_regions), pa as (select image_id, region_id, 1 as piece_no, x, y, w, h // 2 as h from r where font_size = 7
    union all select image_id, region_id, 2, x, y + h // 2, w, h - h // 2 from r where font_size = 7)
  select image_id, region_id, cast(0 as bigint) as piece_no, x, y, w, h from r where font_size not in (6, 7, 8, 9)
  union all select * from pa where (image_id, region_id) not in (select image_id, region_id from r where overflow)
  """.replace("where font_size not in (6, 7, 8, 9)", "where font_size not in (6, 7, 8) and not overflow"))
def _x01(t):
    r = t.text_regions
    pieces = r.where("font_size = 7").selectExpr("image_id", "region_id", "cast(1 as bigint) as piece_no", "x", "y", "w", "h div 2 as h").union(
        r.where("font_size = 7").selectExpr("image_id", "region_id", "cast(2 as bigint)", "x", "y + h div 2", "w", "h - h div 2"))
    return K.suppress(r, r.where("font_size = 6"), r.where("font_size = 8"), pieces, r.where("overflow"))


@query("x02_preserved_conflicts", f"""
  with r as (select *, {_TYPED} as rt, font_size % 2 = 0 as al, label = 'onomatopoeia' and font_size <> 9 or font_size = 12 as kp, font_size > 8 as sc from text_regions)
  select image_id, region_id, 'not_unlocked' as problem from r where al and locked
  union all select image_id, region_id, 'outside_scope' from r where al and not sc and not overflow
  union all select image_id, region_id, 'preserved_and_allowed' from r where al and kp
  union all select image_id, region_id, 'sfx_allowed' from r where al and rt = 'sfx'
  union all select image_id, region_id, 'sfx_not_preserved' from r where rt = 'sfx' and not kp
  union all select image_id, region_id, 'preserved_has_mask' from r where kp and mask_pixels > 0
  union all select image_id, region_id, 'preserved_has_text' from r where kp and visible and trim(translated_text) <> ''
  union all select image_id, -region_id - 1, 'unknown_preserved' from r where font_size = 25
  union all select image_id, -region_id - 1, 'preserved_and_allowed' from r where false""")
def _x02(t):
    r = _typed(t).withColumn("created_by_run", _c("overflow"))
    kept = r.where("(label = 'onomatopoeia' and font_size <> 9) or font_size = 12").select("image_id", "region_id").union(
        r.where("font_size = 25").select("image_id", -_c("region_id") - 1))
    return K.preserved_conflicts(r, r.where("font_size % 2 = 0"), kept, r.where("font_size > 8"))


@query("x03_pair_requests", """
  with q as (select image_id, x // 200 x, y // 300 y, 1 as w, 1 as h, case when locked then 'original' else 'rendered' end kind from text_regions)
  select image_id, x, y, w, h, case when count(distinct kind) = 2 then 'comparison' else min(kind) end as kind from q group by 1, 2, 3, 4, 5""")
def _x03(t):
    return K.pair_requests(t.text_regions.selectExpr("image_id", "x div 200 as x", "y div 300 as y", "1 as w", "1 as h",
                                                     "case when locked then 'original' else 'rendered' end as kind"))


_KIND = "case font_size % 4 when 0 then 'comparison' when 1 then 'annotated' when 2 then 'original' else 'rendered' end"


@query("x05_evidence_views", f"""
  with e as (select *, {_KIND} as kind from text_regions)
  select image_id, region_id as evidence_id, concat(x, ',', y) as crop from e where kind in ('annotated', 'original')
  union all select image_id, region_id, concat(w, ',', h) from e where kind = 'comparison'""")
def _x05(t):
    e = t.text_regions.withColumn("kind", F.expr(_KIND)).withColumn("crop", F.concat_ws(",", "x", "y")).withColumn(
        "panels", F.array(F.struct(F.lit("original").alias("kind"), F.concat_ws(",", "w", "h").alias("crop")),
                          F.struct(F.lit("rendered").alias("kind"), F.concat_ws(",", "x", "h").alias("crop"))))
    return K.evidence_views(e.withColumnRenamed("region_id", "evidence_id"), "original")


@query("x06_required_checks", """
  with s as (select image_id, case font_size % 4 when 0 then 'source' when 1 then 'masks' when 2 then 'scope' else 'other' end ck, visible as ok from text_regions),
  g as (select image_id, count(distinct ck) filter (ck <> 'other') n, count(*) filter (ck = 'other') x, bool_and(ok) a from s group by 1),
  o as (select distinct image_id from review_issues where status = 'open')
  select r.image_id, case when coalesce(n, 0) <> 3 or coalesce(x, 0) > 0 then 'checks_incomplete' when outcome = 'passed' and not coalesce(a, false) then 'check_not_passed'
    when outcome = 'passed' and o.image_id is not null then 'open_issues' else 'accepted' end as verdict
  from review_pages r left join g using (image_id) left join o on r.image_id = o.image_id""")
def _x06(t):
    supplied = t.text_regions.selectExpr("image_id", "case font_size % 4 when 0 then 'source' when 1 then 'masks' when 2 then 'scope' else 'other' end as check",
                                         "visible as passed")
    return K.required_checks(supplied, ["source", "masks", "scope"], t.review_pages.select("image_id", "outcome"), t.review_issues)


@query("x07_publication_checks", """
  with r as (select image_id as run_id, image_id % 3 as cut, clean_path, rendered_path, layer_path from image_pages),
  p as (select distinct image_id as run_id, case font_size % 4 when 0 then 'ocr' when 1 then 'translation' when 2 then 'mask' else 'inpainting' end s from text_regions),
  h as (select run_id, list_sort(list(s)) l from p group by 1),
  n as (select r.*, case cut when 0 then ['ocr', 'translation'] when 1 then ['inpainting', 'mask', 'translation'] else ['inpainting', 'mask', 'ocr', 'rendering', 'translation'] end st,
    coalesce(l, []) l from r left join h using (run_id))
  select run_id, 'stage_proofs' as problem from n where st <> l
  union all select run_id, 'image_missing' from n where (cut > 0 and clean_path is null) or (cut = 2 and (rendered_path is null or layer_path is null))
  union all select run_id, 'page_field_changed' from n where run_id % 5 = 0
  union all select run_id, 'delete_without_detection' from n where run_id % 7 = 0
  union all select run_id, 'history_rewritten' from n where run_id % 11 = 0
  union all select run_id, 'superseded' from n where run_id % 3 <> run_id % 4
  union all select run_id, 'page_changed' from n where run_id % 2 <> run_id % 3""")
def _x07(t):
    runs = t.image_pages.selectExpr(
        "image_id as run_id", "clean_path", "rendered_path", "layer_path", "image_id % 3 as generation", "image_id % 4 as current_generation",
        "image_id % 2 as version", "image_id % 3 as current_version",
        "case image_id % 3 when 0 then array('ocr', 'translation') when 1 then array('translation', 'mask', 'inpainting') "
        "else array('ocr', 'translation', 'mask', 'inpainting', 'rendering') end as stages")
    proofs = t.text_regions.selectExpr("image_id as run_id", "case font_size % 4 when 0 then 'ocr' when 1 then 'translation' when 2 then 'mask' else 'inpainting' end as stage")
    changed = t.image_pages.selectExpr("image_id as run_id", "case when image_id % 5 = 0 then 'original_path' else 'status' end as field")
    ids = lambda k: t.image_pages.where(f"image_id % {k} = 0").selectExpr("image_id as run_id")
    return K.publication_checks(runs, proofs, changed, ids(7), ids(11))
