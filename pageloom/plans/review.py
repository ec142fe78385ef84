"""Quality rules R-01..R-26 and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import quality as Q
from pageloom.plans.frames import FRAME_ISSUES_SQL, text_frames
from pageloom.plans.registry import query

VISIBLE = r"[^\s\p{Z}\p{Cf}\p{Cc}\p{Cs}\p{Mn}\p{Me}]"
_HAS = lambda c: f"regexp_matches({c}, '{VISIBLE}')"
_SEG = "mask_method <> 'manual_mask'"
_FREE = ("(coalesce(constraint_status = 'skipped' and constraint_reason = 'balloon_assignment_unassigned' "
         "and bubble_id is null and role_label = 'free_text' and label = 'text' and assignment_status = 'unassigned', false))")
# Corner offsets of a box turned about its centre; 90 degrees maps a box onto an aligned one.
_TURN = " or ".join(
    f"round(x + w / 2.0 + ({sx} * w / 2.0) * cos(radians(rotation)) - ({sy} * h / 2.0) * sin(radians(rotation)), 9) not between 0 and width"
    f" or round(y + h / 2.0 + ({sx} * w / 2.0) * sin(radians(rotation)) + ({sy} * h / 2.0) * cos(radians(rotation)), 9) not between 0 and height"
    for sx in (-1, 1) for sy in (-1, 1))
_OUT = "(x < 0 or y < 0 or x + w > width or y + h > height)"

RULES = [  # (id, code, severity, DuckDB condition or None when DuckDB's regex cannot say it)
    ("r01", "low_ocr_confidence", "warning", "confidence_available and confidence < 0.65 and not locked"),
    ("r02", "empty_source_text", "warning", f"not {_HAS('source_text')}"),
    ("r03", "ocr_generation_truncated", "warning", "generation_truncated"),
    ("r04", "incomplete_ocr_chunks", "warning", "empty_chunks > 0"),
    ("r05", "ocr_geometry_stale", "warning", "geometry_stale"),
    ("r06", "ocr_invalid_characters", "warning", "contains(source_text, '�')"),
    ("r07", "ocr_repetition", "warning", "source_text = 'aaaaaaaaaaaaaaaa'"),
    ("r08", "missing_translation", "warning", f"not {_HAS('translated_text')}"),
    ("r09", "translation_fallback", "warning", "translation_fallback and not locked"),
    ("r10", "font_too_small", "warning", "font_size < 10"),
    ("r11", "text_overflow", "warning", "layout_warning or overflow"),
    ("r12", "image_boundary_collision", "error", _OUT),
    ("r13", "empty_mask", "warning", "coalesce(mask_pixels, 0) = 0"),
    ("r14", "incomplete_text_mask", "warning", f"{_SEG} and mask_integrity = 'partial'"),
    ("r15", "mask_segmentation_disagreement", "warning", f"{_SEG} and mask_integrity = 'uncertain'"),
    ("r16", "repair_constraint_uncertain", "warning",
     f"constraint_status in ('fallback', 'skipped', 'partial') and not {_FREE}"),
    ("r17", "repair_outside_balloon", "error", "constraint_status is not null and outside_pixels > 0"),
    ("r18", "inpainting_missing", "warning", "clean_path is null"),
    ("r19", "residual_text", "warning", "clean_path is not null and repair_status = 'residual'"),
    ("r20", "residual_outside_mask", "warning",
     "clean_path is not null and repair_status = 'residual' and repair_outside_pixels > 0"),
    ("r21", "repair_verification_uncertain", "warning", "clean_path is not null and repair_status = 'uncertain'"),
    ("r21b", "repair_verification_unavailable", "warning", "clean_path is not null and repair_status = 'unavailable'"),
    ("r22", "orientation_changed", "warning", "source_orientation is not null and source_orientation <> orientation"),
    ("r24", "translation_boundary_collision", "warning",
     f"visible and trim(translated_text) <> '' and case when rotation % 90 = 0 then {_OUT} else ({_TURN}) end"),
]
_JOINED = "(select r.*, p.project_id, p.width, p.height, p.clean_path from text_regions r join image_pages p using (image_id))"
_RULE_SQL = {code: f"select project_id, image_id, region_id, '{code}' as code, '{sev}' as severity from {_JOINED} where {cond}"
             for _, code, sev, cond in RULES}
PAIRS_SQL = """
  select a.image_id, a.region_id first_id, b.region_id second_id,
    greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
      * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as inter,
    greatest(1, least(a.w * a.h, b.w * b.h)) as smaller
  from text_regions a join text_regions b on a.image_id = b.image_id
   and (a.reading_order, a.region_id) < (b.reading_order, b.region_id)"""
_OVERLAP_SQL = f"""select project_id, image_id, first_id as region_id, 'region_overlap' as code, 'warning' as severity
  from ({PAIRS_SQL}) join image_pages using (image_id) where inter * 1.0 / smaller > 0.12"""
_TASK_SQL = """select p.project_id, p.image_id, cast(null as bigint) as region_id, 'task_failed' as code, 'error' as severity
  from processing_tasks t join image_pages p using (image_id) where t.status = 'FAILED'"""
ALL_SQL = " union all ".join([*_RULE_SQL.values(), _OVERLAP_SQL, FRAME_ISSUES_SQL, _TASK_SQL])


def _register(rule: str, code: str) -> None:
    @query(f"{rule}_{code}", _RULE_SQL[code])
    def _run(t):
        return Q.region_issues(t.text_regions, t.image_pages, only=code)


for _rule, _code, _, _cond in RULES:
    _register(_rule, _code)


@query("r23_region_overlap", _OVERLAP_SQL)
def _r23(t):
    return Q.with_project(Q.overlap_findings(t.text_regions), t.image_pages)


@query("r26_task_failed", _TASK_SQL)
def _r26(t):
    return Q.with_project(Q.task_findings(t.processing_tasks), t.image_pages)


@query("j03_overlap_join", f"""select image_id, first_id, second_id, inter, round(inter * 1.0 / smaller, 6) as ratio
  from ({PAIRS_SQL}) where inter * 1.0 / smaller > 0.12""")
def _j03(t):
    return Q.overlap_pairs(t.text_regions).withColumn("ratio", F.round("ratio", 6))


def _findings(t):
    return Q.all_findings(t.text_regions, t.image_pages, t.processing_tasks, text_frames(t))


@query("x04_all_issues", ALL_SQL)
def _x04(t):
    return Q.with_project(_findings(t), t.image_pages)


@query("a07_region_review_rollup", f"""
  with issues as ({ALL_SQL}),
  codes as (select image_id, region_id, string_agg(distinct code, ',' order by code) reasons
            from issues where region_id is not null group by all)
  select r.image_id, r.region_id, coalesce(reasons, '') as reasons, reasons is not null as needs_review
  from text_regions r left join codes c on r.image_id = c.image_id and r.region_id = c.region_id""")
def _a07(t):
    return Q.review_rollup(t.text_regions, _findings(t)).select(
        "image_id", "region_id", F.array_join("review_reasons", ",").alias("reasons"), "needs_review")


@query("a08_page_outcome", f"""
  with issues as ({ALL_SQL}),
  n as (select image_id, count(*) issues, count(*) filter (severity = 'error') errors, count(distinct code) codes
        from issues group by 1)
  select p.project_id, p.image_id, coalesce(issues, 0) as issues, coalesce(errors, 0) as errors,
    coalesce(codes, 0) as codes, case when coalesce(issues, 0) > 0 then 'NEEDS_REVIEW' else 'COMPLETED' end as outcome
  from image_pages p left join n on p.image_id = n.image_id""")
def _a08(t):
    return Q.page_outcome(t.image_pages, _findings(t))
