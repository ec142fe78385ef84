"""Rule-based page review: issues, roll-ups and page outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core import grid
from pageloom.functions import text as X
from pageloom.operators.frames import frame_overlap_join

OCR_THRESHOLD = 0.65
ISSUE_COLUMNS = ["project_id", "image_id", "region_id", "code", "severity"]


def confirmed_free_text(bubble_id: Column, role: Column, label: Column, assignment: Column) -> Column:
    """Free text only when role, class and assignment all say so."""
    return F.coalesce(bubble_id.isNull() & (role == "free_text") & (label == "text")
                      & (assignment == "unassigned"), F.lit(False))


def region_rules(threshold: float = OCR_THRESHOLD) -> list[tuple[str, str, Column]]:
    """(code, severity, condition) over a region row joined to its page."""
    c = F.col
    segmented = F.coalesce(c("mask_method") != "manual_mask", F.lit(True))
    free = (c("constraint_status") == "skipped") & (c("constraint_reason") == "balloon_assignment_unassigned") & \
        confirmed_free_text(c("bubble_id"), c("role_label"), c("label"), c("assignment_status"))
    cleaned = c("clean_path").isNotNull()
    residual = cleaned & (c("repair_status") == "residual")
    return [
        ("low_ocr_confidence", "warning", c("confidence_available") & (c("confidence") < threshold) & ~c("locked")),
        ("empty_source_text", "warning", ~X.has_text(c("source_text"))),
        ("ocr_generation_truncated", "warning", c("generation_truncated")),
        ("incomplete_ocr_chunks", "warning", c("empty_chunks") > 0),
        ("ocr_geometry_stale", "warning", c("geometry_stale")),
        ("ocr_invalid_characters", "warning", X.has_replacement_char(c("source_text"))),
        ("ocr_repetition", "warning", X.has_repetition(c("source_text"))),
        ("missing_translation", "warning", ~X.has_text(c("translated_text"))),
        ("translation_fallback", "warning", c("translation_fallback") & ~c("locked")),
        ("font_too_small", "warning", c("font_size") < 10),
        ("text_overflow", "warning", c("layout_warning") | c("overflow")),
        ("image_boundary_collision", "error", (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > c("width"))
         | (c("y") + c("h") > c("height"))),
        ("empty_mask", "warning", F.coalesce(c("mask_pixels"), F.lit(0)) == 0),
        ("incomplete_text_mask", "warning", segmented & (c("mask_integrity") == "partial")),
        ("mask_segmentation_disagreement", "warning", segmented & (c("mask_integrity") == "uncertain")),
        ("repair_constraint_uncertain", "warning",
         c("constraint_status").isin("fallback", "skipped", "partial") & ~free),
        ("repair_outside_balloon", "error", c("constraint_status").isNotNull() & (c("outside_pixels") > 0)),
        ("inpainting_missing", "warning", ~cleaned),
        ("residual_text", "warning", residual),
        ("residual_outside_mask", "warning", residual & (c("repair_outside_pixels") > 0)),
        ("repair_verification_uncertain", "warning", cleaned & (c("repair_status") == "uncertain")),
        ("repair_verification_unavailable", "warning", cleaned & (c("repair_status") == "unavailable")),
        ("orientation_changed", "warning", c("source_orientation").isNotNull()
         & (c("source_orientation") != c("orientation"))),
        ("translation_boundary_collision", "warning", frame_outside_page()),
    ]


def frame_outside_page() -> Column:
    """Is the (rotated) translated frame of a visible, translated region off the page?

    A box turned by a multiple of 90 degrees is already an aligned frame and is
    taken as drawn; any other angle turns it about its centre.
    """
    c = F.col
    cos, sin = F.abs(F.cos(F.radians("rotation"))), F.abs(F.sin(F.radians("rotation")))
    plain = c("rotation") % 90 == 0
    half_w = F.when(plain, c("w") / 2).otherwise(c("w") / 2 * cos + c("h") / 2 * sin)
    half_h = F.when(plain, c("h") / 2).otherwise(c("w") / 2 * sin + c("h") / 2 * cos)
    cx, cy = c("x") + c("w") / 2, c("y") + c("h") / 2
    off = ((F.round(cx - half_w, 9) < 0) | (F.round(cx + half_w, 9) > c("width"))
           | (F.round(cy - half_h, 9) < 0) | (F.round(cy + half_h, 9) > c("height")))
    return c("visible") & (X.strip(c("translated_text")) != "") & off


PAGE_RULES = {"image_boundary_collision", "inpainting_missing", "residual_text", "residual_outside_mask",
              "repair_verification_uncertain", "repair_verification_unavailable", "translation_boundary_collision"}
PASS_SIZE = 6


def region_findings(regions: DataFrame, pages: DataFrame, threshold: float = OCR_THRESHOLD,
                    only: str | None = None) -> DataFrame:
    """(image_id, region_id, code, severity) for every rule that fires.

    Rules run in passes of six: one generated method holding all of them is
    past the size the JIT compiles and runs many times slower.  Each pass reads
    only its rules' columns, and only the rules about the page join it.
    """
    rules = [r for r in region_rules(threshold) if only in (None, r[0])]
    plain = [r for r in rules if r[0] not in PAGE_RULES]
    paged = [r for r in rules if r[0] in PAGE_RULES]
    joined = regions.join(pages.select("image_id", "width", "height", "clean_path"), "image_id")
    passes = [(df, group[i:i + PASS_SIZE]) for df, group in ((regions, plain), (joined, paged))
              for i in range(0, len(group), PASS_SIZE)]
    out = None
    for df, group in passes:
        found = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
                          for code, sev, cond in group])
        # explode_outer: the plain form would evaluate every rule again as a filter.
        part = (df.select("image_id", "region_id", F.explode_outer(found).alias("_i")).where("_i is not null")
                .select("image_id", "region_id", "_i.code", "_i.severity"))
        out = part if out is None else out.unionByName(part)
    return out


def with_project(findings: DataFrame, pages: DataFrame) -> DataFrame:
    return findings.join(pages.select("image_id", "project_id"), "image_id").select(*ISSUE_COLUMNS)


def region_issues(regions: DataFrame, pages: DataFrame, threshold: float = OCR_THRESHOLD,
                  only: str | None = None) -> DataFrame:
    return with_project(region_findings(regions, pages, threshold, only), pages)


def overlap_pairs(regions: DataFrame, share: float = 0.12) -> DataFrame:
    """Pairs on a page whose overlap exceeds ``share`` of the smaller box."""
    boxes = regions.select("image_id", "region_id", "reading_order", "x", "y", "w", "h")
    rank = lambda k: F.struct(k["reading_order"].alias("at"), k["region_id"].alias("id"))
    smaller = F.greatest(F.lit(1), F.least(F.col("a_w") * F.col("a_h"), F.col("b_w") * F.col("b_h")))
    pairs = grid.among(boxes, lambda a, b: rank(a) < rank(b))
    return (pairs.withColumn("ratio", F.col("inter") / smaller).where(F.col("ratio") > share)
            .select("image_id", F.col("a_region_id").alias("first_id"), F.col("b_region_id").alias("second_id"),
                    "inter", "ratio"))


def overlap_findings(regions: DataFrame) -> DataFrame:
    return overlap_pairs(regions).select("image_id", F.col("first_id").alias("region_id"),
                                         F.lit("region_overlap").alias("code"), F.lit("warning").alias("severity"))


def task_findings(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'FAILED'").select(
        "image_id", F.lit(None).cast("bigint").alias("region_id"), F.lit("task_failed").alias("code"),
        F.lit("error").alias("severity"))


def frame_findings(frames: DataFrame) -> DataFrame:
    """Overlaps of translated frames (image_id, region_id, seq, polygon)."""
    return frame_overlap_join(frames).select("image_id", F.col("first_id").alias("region_id"),
                                             F.lit("translation_overlap").alias("code"), F.lit("warning").alias("severity"))


def all_findings(regions: DataFrame, pages: DataFrame, tasks: DataFrame, frames: DataFrame) -> DataFrame:
    """Region, pair, frame and task findings together, without their project."""
    return (region_findings(regions, pages).unionByName(overlap_findings(regions)).unionByName(frame_findings(frames))
            .unionByName(task_findings(tasks)))


def all_issues(regions: DataFrame, pages: DataFrame, tasks: DataFrame, frames: DataFrame) -> DataFrame:
    return with_project(all_findings(regions, pages, tasks, frames), pages)


def review_rollup(regions: DataFrame, issues: DataFrame) -> DataFrame:
    """Sorted distinct reasons and the review flag of every region."""
    reasons = (issues.where("region_id is not null").groupBy("image_id", "region_id")
               .agg(F.sort_array(F.collect_set("code")).alias("review_reasons")))
    return (regions.select("image_id", "region_id").join(reasons, ["image_id", "region_id"], "left")
            .withColumn("needs_review", F.col("review_reasons").isNotNull())
            .withColumn("review_reasons", F.coalesce("review_reasons", F.array().cast("array<string>"))))


def page_outcome(pages: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"),
        F.countDistinct("code").alias("codes"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return pages.select("project_id", "image_id").join(counts, "image_id", "left").select(
        "project_id", "image_id", zero("issues"), zero("errors"), zero("codes"),
        F.when(F.coalesce("issues", F.lit(0)) > 0, "NEEDS_REVIEW").otherwise("COMPLETED").alias("outcome"))
