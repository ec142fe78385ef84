"""P-01..P-24 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.operators import filters as P
from pageloom.plans.registry import query
from pageloom.plans.review import VISIBLE

_HAS = lambda c: f"regexp_matches({c}, '{VISIBLE}')"
_FULL = lambda c: f"(trim(replace({c}, '​', 'z')) <> '')"
ACTIVE = "('QUEUED', 'RUNNING', 'CANCELLING', 'PAUSED')"


@query("p01_project_index", """
  select p.project_id, p.name, p.updated_us, coalesce(n, 0) as page_count, lo as first_order, cover_id
  from projects p left join (select project_id, count(*) n, min(order_index) lo, arg_min(image_id, order_index) cover_id
    from image_pages group by 1) g using (project_id)""")
def _p01(t):
    return P.project_index(t.projects, t.image_pages).select(
        "project_id", "name", "updated_us", "page_count", "first_order", "cover_id")


@query("p02_page_index", """
  select p.project_id, p.image_id, order_index, stage, exempt, clean_path, layer_path, coalesce(n, 0) as region_count
  from image_pages p left join (select image_id, count(*) n from text_regions group by 1) r using (image_id)""")
def _p02(t):
    return P.page_index(t.image_pages, t.text_regions, ["stage", "exempt", "clean_path", "layer_path"])


@query("p03_task_list", """
  select task_id, status, created_us from processing_tasks
  order by case when status in ('RUNNING','CANCELLING') then 0 when status = 'QUEUED' then 1 when status = 'PAUSED' then 2
    else 3 end, created_us desc, task_id desc limit 500 offset 20""")
def _p03(t):
    return P.task_list(t.processing_tasks, True, 500, 20).select("task_id", "status", "created_us")


@query("p04_status_by_ids", """
  with req as (select event_id as position, user_id * 211 as task_id from events_log)
  select r.task_id, min(position) as position, max(status) as status, max(status) is null as missing
  from req r left join processing_tasks t on r.task_id = t.task_id group by r.task_id""")
def _p04(t):
    asked = t.events_log.select(F.col("event_id").alias("position"), (F.col("user_id") * 211).alias("task_id"))
    return P.status_by_ids(asked, t.processing_tasks)


@query("p05_search_projects", """
  select p.project_id, p.name, coalesce(n, 0) as page_count, latest_run, p.updated_us
  from projects p left join (select project_id, count(*) n, arg_max(image_id, (updated_us, image_id)) latest_run
    from image_pages group by 1) g using (project_id) where contains(p.name, '#00000001')""")
def _p05(t):
    runs = t.image_pages.select("project_id", F.col("image_id").alias("run_id"), F.col("updated_us").alias("created_us"))
    return P.search_projects(t.projects, t.image_pages, runs, "#00000001")


_NEEDS = f"""select p.*, case when exempt then false when status = 'OCR_DONE' then false when status <> 'FAILED' then true
  else coalesce(b, true) end as needs_ocr
  from image_pages p left join (select image_id, bool_or(not {_FULL('source_text')}) b from text_regions group by 1) using (image_id)"""


@query("p06_batch_eligible", f"""
  select project_id, image_id, order_index from ({_NEEDS}) where needs_ocr
   and image_id not in (select image_id from processing_tasks where status in {ACTIVE})
   and image_id in (select image_id from text_regions)""")
def _p06(t):
    return P.batch_eligible(t.image_pages, t.text_regions, t.processing_tasks, True, True).select(
        "project_id", "image_id", "order_index")


@query("p07_needs_ocr", f"select image_id, status, needs_ocr from ({_NEEDS})")
def _p07(t):
    return P.needs_ocr(t.image_pages, t.text_regions).select("image_id", "status", "needs_ocr")


def _files(t):
    pages = t.image_pages
    return (pages.where("rendered_path is not null and width > 0").select(F.col("rendered_path").alias("path"))
            .union(pages.where("layer_path is not null").select("layer_path")))


@query("p08_needs_export_render", f"""
  select project_id, image_id, coalesce(old, false) or rendered_path is null or layer_path is null as needs_render
  from image_pages left join (select image_id, bool_or(visible and {_FULL('translated_text')} and renderer_version <> 5) old
    from text_regions group by 1) using (image_id)""")
def _p08(t):
    return P.needs_export_render(t.image_pages, t.text_regions, _files(t), ["translated", "text_layer"])


def _rendered(t):
    regions = t.text_regions.withColumn("snapshot", F.concat_ws(",", "x", "y", "w", "h", "font_size"))
    was = regions.where("font_size <> 25").withColumn(
        "snapshot", F.when(F.col("x") % 89 == 0, F.lit("older")).otherwise(F.col("snapshot")))
    return P.render_is_current(t.image_pages, regions, was, _files(t))


CURRENT_SQL = f"""select project_id, image_id, coalesce(same, true) and rendered_path is not null as current
  from image_pages left join (select image_id, bool_and(font_size <> 25 and x % 89 <> 0
      and not (visible and {_FULL('translated_text')} and renderer_version <> 5)) same
    from text_regions group by 1) using (image_id)"""


@query("p09_render_is_current", CURRENT_SQL)
def _p09(t):
    return _rendered(t)


_STAGES = "['detection','ocr','translation','mask','inpainting','rendering']"
_START = "case event_type when 'click' then 'full' when 'view' then 'ocr' when 'signup' then 'translation' when 'error' then 'mask' else 'rendering' end"
_END = "case k % 4 when 0 then 'full' when 1 then 'inpainting' when 2 then 'translation' else 'ocr' end"


@query("p10_stage_range", f"""
  with e as (select event_id, {_START} as s, {_END} as f from events_log),
  i as (select *, list_position({_STAGES}, case s when 'full' then 'detection' else s end) a,
    list_position({_STAGES}, case f when 'full' then 'rendering' else f end) b from e)
  select event_id, case when a <= b then array_to_string(list_concat(case s when 'translation' then ['ocr'] else [] end,
    ({_STAGES})[a:b]), ',') end as stages from i""")
def _p10(t):
    e = t.events_log.selectExpr("event_id", f"{_START} as s", f"{_END} as f")
    return e.select("event_id", F.array_join(P.stage_range(F.col("s"), F.col("f")), ",").alias("stages"))


_TYPED = "case label when 'onomatopoeia' then 'sfx' when 'text' then 'bubble_simple' else 'background_simple' end"


def _typed(t):
    return t.text_regions.withColumn("region_type", F.expr(_TYPED))


@query("p11_eligible_regions", f"""
  select image_id, region_id from text_regions where not locked and {_TYPED} <> 'sfx' and font_size <> 6
    and (font_size >= 10 or overflow)""")
def _p11(t):
    r = _typed(t).withColumn("created_by_run", F.col("overflow"))
    keys = ["image_id", "region_id"]
    return P.eligible_regions(r, r.where("font_size = 6").select(*keys), r.where("font_size >= 10").select(*keys)).select(*keys)


_DRAFT = {
    "confidence": "confidence * 1.5", "font_size": "font_size * 25", "font_weight": "50 * (x % 20)",
    "stroke_width": "x % 60", "line_spacing": "(y % 50) / 10.0", "character_spacing": "y % 120 - 22",
    "rotation": "x - 380", "opacity": "font_size / 24.0", "w": "w - 43", "h": "h - 31", "vertices": "2 + x % 3",
    "orientation": "case y % 4 when 0 then 'diagonal' else orientation end",
    "region_type": "case label when 'onomatopoeia' then 'sfx' when 'text' then 'bubble_simple' else label end"}
_DRAFT_SQL = "(select image_id, region_id, " + ", ".join(f"{e} as {n}" for n, e in _DRAFT.items()) + " from text_regions)"
_CHECKS = {**{f"{n}_range": f"{n} not between {lo} and {hi}" for n, (lo, hi) in P.BOUNDS.items()},
           "bbox": "w <= 0 or h <= 0", "polygon": "vertices < 3",
           "orientation": "orientation not in ('horizontal','vertical','rotated')",
           "region_type": "region_type not in ('bubble_simple','bubble_complex','background_simple','background_complex','sfx')"}


@query("p12_check_constraints", "with d as " + _DRAFT_SQL + " " + " union all ".join(
    f"select image_id, region_id, '{n}' as violation from d where {c}" for n, c in _CHECKS.items()))
def _p12(t):
    draft = t.text_regions.selectExpr("image_id", "region_id", *[f"{e} as {n}" for n, e in _DRAFT.items()])
    return P.check_constraints(draft)


@query("p12_repeated_region_keys", """select image_id, reading_order, count(*) as n from text_regions
  group by 1, 2 having count(*) > 1""")
def _p12b(t):
    return P.repeated_keys(t.text_regions, ["image_id", "reading_order"])


@query("p13_check_in_page_bounds", """
  select image_id, region_id, true as finite, x + w <= width and y + h <= height as bbox_inside,
    x + w <= width and y + h + 100 <= height and x - 20 >= 0 as polygon_inside
  from text_regions join image_pages using (image_id)
  where not (x + w <= width and y + h + 100 <= height and x - 20 >= 0)""")
def _p13(t):
    c = F.col
    poly = F.array(G.point(c("x"), c("y")), G.point(c("x") + c("w"), c("y")),
                   G.point(c("x") + c("w"), c("y") + c("h") + 100), G.point(c("x") - 20, c("y") + c("h")))
    return P.check_in_page(t.text_regions.withColumn("polygon", poly), t.image_pages)


_CLASS = "case font_size % 5 when 0 then 'unavailable' when 1 then 'uncertain' else 'classified' end"


@query("p14_split_roles", f"""
  with d as (select image_id, label, {_CLASS} as st, visible as ex, concat('reason-', font_size % 3) as reason,
    concat('policy-', font_size % 2) as policy from text_regions)
  select image_id, count(*) filter (not (st = 'classified' and label = 'onomatopoeia' and ex)) as kept,
    count(*) filter (st = 'classified' and label = 'onomatopoeia' and ex) as excluded,
    count(*) filter (label = 'uncertain') as uncertain,
    case when bool_or(st in ('classified', 'uncertain')) then 'completed' else max(st) end as status,
    coalesce(string_agg(distinct reason, ',' order by reason) filter (st = 'unavailable'), '') as reasons,
    case when min(policy) = max(policy) then min(policy) end as policy
  from d group by image_id""")
def _p14(t):
    d = t.text_regions.selectExpr("image_id", "label", f"{_CLASS} as class_status", "visible as excluded",
                                  "concat('reason-', font_size % 3) as reason", "concat('policy-', font_size % 2) as policy")
    return P.role_report(d)


@query("p15_threshold_detections", """select image_id, region_id, label, confidence from text_regions
  where confidence > case label when 'text' then 0.25 when 'onomatopoeia' then 0.2 else 0.5 end""")
def _p15(t):
    return P.keep_detections(t.text_regions).select("image_id", "region_id", "label", "confidence")


@query("p16_extract_references")
def _p16(t):
    wrapped = F.to_json(F.struct(F.struct(F.col("url").alias("link"), F.array(F.struct(F.col("html").alias("body"))).alias("inner")).alias("a"),
                                 F.create_map(F.col("url"), F.col("page_id")).alias("b")))
    return P.extract_references(t.raw("pages").select("page_id", wrapped.alias("j")), "page_id", "j", "http")


@query("p17_redact")
def _p17(t):
    c = F.col
    nested = F.to_json(F.struct(c("event_id"), F.struct(c("props").alias("Password"), F.struct(
        F.lit("").alias("api_key"), c("props").alias("note")).alias("inner")).alias("body")))
    return t.events_log.select("event_id", P.redact(nested).alias("redacted"))


@query("p18_pending_translation", f"""select image_id, region_id from text_regions
  where not locked and (overflow or not {_HAS('translated_text')}) and {_HAS('source_text')}""")
def _p18(t):
    r = t.text_regions
    return P.pending_translation(r, False, r.where("overflow")).select("image_id", "region_id")


@query("p19_pending_ocr", f"""select image_id, region_id from text_regions
  where not locked and (geometry_stale or not {_HAS('source_text')})""")
def _p19(t):
    r = t.text_regions
    return P.pending_ocr(r, False, r.where("geometry_stale")).select("image_id", "region_id")


def _text_work(t):
    r = _typed(t).withColumn("ocr_done", F.col("generation_truncated")).withColumn("translation_stale", F.col("overflow"))
    return P.text_work_request(t.image_pages, r)


WORK_SQL = f"""
  select project_id, image_id, start_stage, case when start_stage is not null then 'translation' end as end_stage,
    case when start_stage is not null then coalesce(sel, 0) end as selected,
    case when start_stage is not null then coalesce(stale, 0) end as stale
  from (select *, case when n is null and rendered_path is null and status in ('UPLOADED', 'FAILED') then 'detection'
      when mo > 0 then 'ocr' when mt > 0 then 'translation' end as start_stage
    from image_pages left join (
      select image_id, count(*) n, count(*) filter (o) mo, count(*) filter (tr) mt, count(*) filter (o or tr) sel,
        count(*) filter (s) stale
      from (select image_id, not locked and {_TYPED} <> 'sfx' and geometry_stale as s,
          not locked and {_TYPED} <> 'sfx' and (geometry_stale or (not {_FULL('source_text')} and not generation_truncated)) as o,
          not locked and {_TYPED} <> 'sfx' and {_FULL('source_text')} and (not {_FULL('translated_text')} or overflow) as tr
        from text_regions) group by 1) using (image_id))"""


@query("p20_text_work_request", WORK_SQL)
def _p20(t):
    return _text_work(t)


@query("p21_page_detail", """
  with r as (select *, row_number() over (partition by image_id order by reading_order, region_id) rn,
    count(*) over (partition by image_id) n from text_regions
    where image_id in (select image_id from review_pages where reviewed_version = current_version))
  select image_id, region_id, rn as position, n as matched, cast(case when 4 < n then 4 end as bigint) as next_offset, mask_method,
    repair_status, overflow from r where rn between 2 and 4""")
def _p21(t):
    v = t.review_pages.select("image_id", F.col("reviewed_version").alias("expected_version"), "current_version")
    return P.page_detail(t.text_regions, v, 1, 3).select(
        "image_id", "region_id", "position", "matched", "next_offset", "mask_method", "repair_status", "overflow")


@query("p22_confirmed_free_text", """select image_id, region_id, bubble_id is null and role_label = 'free_text'
  and label = 'text' and assignment_status = 'unassigned' as free_text from text_regions""")
def _p22(t):
    return P.confirmed_free_text_report(t.text_regions).select("image_id", "region_id", "free_text")


@query("p23_correction_allowed", f"""
  with w as ({WORK_SQL}), f as (select run_id, status in {ACTIVE} as a,
      start_stage is not null and status not in ('FAILED', 'CANCELLED') as x
    from review_pages join processing_tasks using (image_id) join w using (image_id))
  select run_id, bool_or(a) as active, bool_or(x) as text_pending, not bool_or(a) and not bool_or(x) as allowed
  from f group by 1""")
def _p23(t):
    return P.correction_allowed(t.review_pages, t.processing_tasks, _text_work(t))


NOW_US = 899_000_000_000_000  # an injected clock inside the data's dates


@query("p24_delivery_blockers", f"""
  with cur as ({CURRENT_SQL}),
  j as (select r.*, t.status, c.current, r.run_id % 41 = 0 as drift, outcome is not null and reviewed_version = current_version as fresh
    from review_pages r join processing_tasks t using (image_id) join cur c using (image_id))
  select run_id, image_id, 'leased' as reason from j where lease_expires_us > {NOW_US}
  union all select run_id, image_id, 'correction_open' from j where correction_open
  union all select run_id, image_id, 'review_missing_or_stale' from j where not fresh
  union all select run_id, image_id, 'issues_undecided' from j where fresh and outcome = 'issues' and not deliver_with_issues
  union all select run_id, image_id, 'rendering_stale' from j where fresh and outcome = 'passed' and not current
  union all select run_id, image_id, 'task_active' from j where status in {ACTIVE}
  union all select run_id, image_id, 'configuration_changed' from j where drift""")
def _p24(t):
    drifted = t.projects.where("project_id % 41 = 0").select(F.col("project_id").alias("run_id"))
    return P.delivery_blockers(t.review_pages, t.processing_tasks, _rendered(t), drifted, NOW_US)
