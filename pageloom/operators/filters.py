"""Projections, filters and per-row predicates over the state tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.core import ranking
from pageloom.functions import text as X

# Fixed values -----------------------------------------------------------
OCR_COMPLETE = ("OCR_DONE", "TRANSLATING", "TRANSLATED", "MASK_GENERATING", "INPAINTING", "INPAINTED",
                "LAYOUTING", "RENDERING", "COMPLETED", "NEEDS_REVIEW")
STAGES = ("detection", "ocr", "translation", "mask", "inpainting", "rendering")
ACTIVE = ("QUEUED", "RUNNING", "CANCELLING", "PAUSED")
SECRET_KEYS = ("api_key", "encrypted_api_key", "access_token", "refresh_token", "authorization", "password",
               "client_secret")
THRESHOLDS = {"text": 0.25, "bubble": 0.5, "panel": 0.5, "onomatopoeia": 0.2}
RENDER_VERSION = 5
# ------------------------------------------------------------------------

_c = F.col


def _zero(name: str) -> Column:
    return F.coalesce(_c(name), F.lit(0).cast("bigint")).alias(name)


def project_index(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Projects with page count and cover (the page at the lowest order), newest first."""
    cover = pages.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.min("order_index").alias("first_order"),
        F.min_by("image_id", F.struct("order_index", "image_id")).alias("cover_id"))
    return (projects.join(cover, "project_id", "left").withColumn("page_count", _zero("page_count"))
            .orderBy(F.desc("updated_us"), "project_id"))


def page_index(pages: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages with their region count and only the named extra columns."""
    counts = regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("region_count"))
    return (pages.select("project_id", "image_id", "order_index", *keys).join(counts, "image_id", "left")
            .withColumn("region_count", _zero("region_count")))


def task_rank(status: Column) -> Column:
    return (F.when(status.isin("RUNNING", "CANCELLING"), 0).when(status == "QUEUED", 1)
            .when(status == "PAUSED", 2).otherwise(3))


def task_list(tasks: DataFrame, active_first: bool, limit: int, offset: int = 0,
              **equal: object) -> DataFrame:
    """A page of tasks; the page size is the feature and may be at most 500."""
    if not 0 < limit <= 500:
        raise ValueError(f"a page holds 1 to 500 tasks, not {limit}")
    for name, value in equal.items():
        tasks = tasks.where(_c(name) == F.lit(value))
    first = [task_rank(_c("status"))] if active_first else []
    return tasks.orderBy(*first, F.desc("created_us"), F.desc("task_id")).offset(offset).limit(limit)


def status_by_ids(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each requested id once, at its first position, with its status or null when missing."""
    wanted = requests.groupBy("task_id").agg(F.min("position").alias("position"))
    return (wanted.join(tasks.select("task_id", "status"), "task_id", "left")
            .withColumn("missing", _c("status").isNull()))


def search_projects(projects: DataFrame, pages: DataFrame, runs: DataFrame, text: str) -> DataFrame:
    """Projects whose name holds the literal text, with page count and latest run."""
    counts = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("page_count"))
    latest = runs.groupBy("project_id").agg(F.max_by("run_id", F.struct("created_us", "run_id")).alias("latest_run"))
    found = projects.where(F.contains(_c("name"), F.lit(text)))
    return (found.join(counts, "project_id", "left").join(latest, "project_id", "left")
            .select("project_id", "name", _zero("page_count"), "latest_run", "updated_us")
            .orderBy(F.desc("updated_us"), "project_id"))


def needs_ocr(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages still to be recognised; a failed page only when it has no or blank text."""
    state = regions.groupBy("image_id").agg(
        F.bool_or(F.regexp_replace("source_text", X.SPACES, "") == "").alias("any_blank"))
    verdict = (F.when(_c("exempt"), False).when(_c("status").isin(*OCR_COMPLETE), False)
               .when(_c("status") != "FAILED", True).otherwise(F.coalesce("any_blank", F.lit(True))))
    return pages.join(state, "image_id", "left").withColumn("needs_ocr", verdict).drop("any_blank")


def batch_eligible(pages: DataFrame, regions: DataFrame, tasks: DataFrame, only_unrecognized: bool = False,
                   only_with_regions: bool = False) -> DataFrame:
    """Pages a new batch may take, without pages that have an active task."""
    out = pages
    if only_unrecognized or only_with_regions:
        out = out.join(tasks.where(_c("status").isin(*ACTIVE)).select("image_id"), "image_id", "left_anti")
    if only_unrecognized:
        out = needs_ocr(out, regions).where("needs_ocr").drop("needs_ocr")
    if only_with_regions:
        out = out.join(regions.select("image_id"), "image_id", "left_semi")
    return out


def _shown() -> Column:
    return _c("visible") & (F.regexp_replace("translated_text", X.SPACES, "") != "")


def needs_export_render(pages: DataFrame, regions: DataFrame, files: DataFrame, formats: Sequence[str]) -> DataFrame:
    """Does an export in ``formats`` first need this page rendered again?"""
    old = regions.groupBy("image_id").agg(
        F.bool_or(_shown() & (_c("renderer_version") != RENDER_VERSION)).alias("old_version"))
    out = pages.join(old, "image_id", "left")
    need = F.coalesce("old_version", F.lit(False)) if formats else F.lit(False)
    for name, column in (("translated", "rendered_path"), ("text_layer", "layer_path")):
        if name in formats:
            present = files.select(_c("path").alias(column), F.lit(True).alias(f"_{name}"))
            out = out.join(present, column, "left")
            need = need | _c(f"_{name}").isNull()
    return out.select("project_id", "image_id", need.alias("needs_render"))


def render_is_current(pages: DataFrame, regions: DataFrame, recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Rendered file present, same region set, same visual inputs, current renderer.

    ``recorded`` holds (image_id, region_id, snapshot) written at render time;
    the sets are compared by a full join and a per-page fold, never as lists.
    """
    now = regions.select("image_id", "region_id", F.lit(True).alias("_now"), "snapshot",
                         (_shown() & (_c("renderer_version") != RENDER_VERSION)).alias("_old"))
    then = recorded.select("image_id", "region_id", F.lit(True).alias("_then"), _c("snapshot").alias("_was"))
    same = _c("_now") & _c("_then") & _c("snapshot").eqNullSafe(_c("_was")) & ~_c("_old")
    folded = now.join(then, ["image_id", "region_id"], "full").groupBy("image_id").agg(
        F.bool_and(F.coalesce(same, F.lit(False))).alias("_same"))
    present = files.select(_c("path").alias("rendered_path"), F.lit(True).alias("_file"))
    return (pages.join(folded, "image_id", "left").join(present, "rendered_path", "left")
            .select("project_id", "image_id",
                    (F.coalesce("_same", F.lit(True)) & _c("_file").isNotNull()).alias("current")))


def stage_range(start: Column, end: Column) -> Column:
    """Stages from start to end, null when the range is invalid."""
    every = F.array(*[F.lit(s) for s in STAGES])
    first = F.array_position(every, F.when(start == "full", STAGES[0]).otherwise(start))
    last = F.array_position(every, F.when(end == "full", STAGES[-1]).otherwise(end))
    picked = F.slice(every, first, F.greatest(last - first + 1, F.lit(0)))
    picked = F.when(start == "translation", F.concat(F.array(F.lit("ocr")), picked)).otherwise(picked)
    return F.when((first > 0) & (last >= first), picked)


def eligible_regions(regions: DataFrame, excluded: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Unlocked, not lettering-as-art, not excluded, and in scope or made by this run."""
    out = regions.where(~_c("locked") & (_c("region_type") != "sfx")).join(excluded, ["image_id", "region_id"], "left_anti")
    if scope is not None:
        marked = scope.select("image_id", "region_id", F.lit(True).alias("_in_scope"))
        out = out.join(marked, ["image_id", "region_id"], "left").where(
            _c("_in_scope").isNotNull() | _c("created_by_run")).drop("_in_scope")
    return out


# Column -> inclusive bounds
BOUNDS = {"confidence": (0.0, 1.0), "font_size": (1, 512), "font_weight": (100, 900), "stroke_width": (0, 50),
          "line_spacing": (0.5, 4.0), "character_spacing": (-20, 100), "rotation": (-360, 360), "opacity": (0.0, 1.0)}
ORIENTATIONS = ("horizontal", "vertical", "rotated")
REGION_TYPES = ("bubble_simple", "bubble_complex", "background_simple", "background_complex", "sfx")


def check_constraints(regions: DataFrame) -> DataFrame:
    """(image_id, region_id, violation) for every broken bound or enum."""
    found = [F.when(~_c(name).between(low, high), F.lit(f"{name}_range")) for name, (low, high) in BOUNDS.items()]
    found += [F.when((_c("w") <= 0) | (_c("h") <= 0), F.lit("bbox")),
              F.when(_c("vertices") < 3, F.lit("polygon")),
              F.when(~_c("orientation").isin(*ORIENTATIONS), F.lit("orientation")),
              F.when(~_c("region_type").isin(*REGION_TYPES), F.lit("region_type"))]
    return regions.select("image_id", "region_id", F.explode(F.array_compact(F.array(*found))).alias("violation"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break uniqueness, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_in_page(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Frames that leave their page, have no size or hold a non-finite number."""
    c = _c
    finite = F.lit(True)
    for name in ("x", "y", "w", "h"):
        finite = finite & c(name).isNotNull() & ~F.isnan(c(name)) & (F.abs(c(name)) < float("inf"))
    inside = ((c("x") >= 0) & (c("y") >= 0) & (c("w") > 0) & (c("h") > 0)
              & (c("x") + c("w") <= c("width")) & (c("y") + c("h") <= c("height")))
    vertices = F.forall(c("polygon"), lambda v: v["x"].between(0, c("width")) & v["y"].between(0, c("height")))
    return (frames.join(pages.select("image_id", "width", "height"), "image_id")
            .select("image_id", "region_id", finite.alias("finite"), F.coalesce(inside, F.lit(False)).alias("bbox_inside"),
                    F.coalesce(vertices, F.lit(True)).alias("polygon_inside"))
            .where("not (finite and bbox_inside and polygon_inside)"))


def excluded_as_art(label: Column, status: Column, excluded: Column) -> Column:
    return F.coalesce((status == "classified") & (label == "onomatopoeia") & excluded, F.lit(False))


def role_report(detections: DataFrame) -> DataFrame:
    """Per page: kept and excluded counts, status, reasons, shared policy."""
    out = excluded_as_art(_c("label"), _c("class_status"), _c("excluded"))
    known = _c("class_status").isin("classified", "uncertain")
    return detections.groupBy("image_id").agg(
        F.count_if(~out).alias("kept"), F.count_if(out).alias("excluded"),
        F.count_if(_c("label") == "uncertain").alias("uncertain"),
        F.when(F.bool_or(known), "completed").otherwise(F.max("class_status")).alias("status"),
        F.array_join(F.sort_array(F.collect_set(F.when(_c("class_status") == "unavailable", _c("reason")))), ",").alias("reasons"),
        F.when(F.min("policy") == F.max("policy"), F.min("policy")).alias("policy"))


def keep_detections(predictions: DataFrame, options: dict[str, float] | None = None) -> DataFrame:
    """Predictions strictly above their label's threshold."""
    limits = THRESHOLDS | (options or {})
    for label, value in limits.items():
        if not 0.2 <= value <= 1:
            raise ValueError(f"threshold of {label} must lie in [0.2, 1]")
    floor = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    return predictions.where(_c("confidence") > F.element_at(floor, _c("label")))


def extract_references(df: DataFrame, id_column: str, json_column: str, prefix: str) -> DataFrame:
    """Every key or value string of the JSON, at any depth, that starts with ``prefix``."""
    tokens = F.regexp_extract_all(json_column, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'), F.lit(1))
    plain = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), T.ArrayType(T.StringType()))
    return (df.select(id_column, F.explode(plain).alias("reference"))
            .where(F.startswith("reference", F.lit(prefix))).distinct())


def _redacted(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if v and k.lower() in SECRET_KEYS else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


def redact(c: Column) -> Column:
    """Blank the non-empty values of secret-named keys at any depth."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else json.dumps(
                _redacted(json.loads(t)), ensure_ascii=False, separators=(",", ":")))
    return run(c)


def pending_translation(regions: DataFrame, force: bool, listed: DataFrame | None = None,
                        explicit: bool = False) -> DataFrame:
    """Regions to translate now."""
    chosen = F.lit(force) | ~X.has_text(_c("translated_text"))
    if listed is not None:
        regions = regions.join(listed.select("image_id", "region_id", F.lit(True).alias("_listed")),
                               ["image_id", "region_id"], "left")
        chosen = chosen | _c("_listed").isNotNull()
    unlocked = ~_c("locked") | F.lit(force and explicit)
    return regions.where(unlocked & chosen & X.has_text(_c("source_text"))).drop("_listed")


def out_of_scope(listed: DataFrame, regions: DataFrame) -> DataFrame:
    """Listed ids that no region in scope carries."""
    return listed.join(regions, ["image_id", "region_id"], "left_anti")


def pending_ocr(regions: DataFrame, force: bool, reocr: DataFrame | None = None, explicit: bool = False) -> DataFrame:
    """Regions to recognise now."""
    chosen = F.lit(force) | ~X.has_text(_c("source_text"))
    if reocr is not None:
        regions = regions.join(reocr.select("image_id", "region_id", F.lit(True).alias("_listed")),
                               ["image_id", "region_id"], "left")
        chosen = chosen | _c("_listed").isNotNull()
    return regions.where((~_c("locked") | F.lit(force and explicit)) & chosen).drop("_listed")


def text_work_request(pages: DataFrame, regions: DataFrame, translate: bool = True) -> DataFrame:
    """Per page the text stages still missing, with the number of regions concerned."""
    source, target = (F.regexp_replace(n, X.SPACES, "") for n in ("source_text", "translated_text"))
    open_ = ~_c("locked") & (_c("region_type") != "sfx")
    stale = open_ & _c("geometry_stale")
    no_ocr = stale | (open_ & (source == "") & ~_c("ocr_done"))
    no_text = open_ & (source != "") & ((target == "") | _c("translation_stale"))
    facts = regions.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(no_ocr).alias("missing_ocr"),
        F.count_if(no_text).alias("missing_translation"), F.count_if(no_ocr | no_text).alias("selected"),
        F.count_if(stale).alias("stale"))
    end = "translation" if translate else "ocr"
    detected = _c("rendered_path").isNotNull() | ~_c("status").isin("UPLOADED", "DETECTING", "FAILED")
    start = (F.when(_c("rows").isNull() & ~detected, "detection").when(_c("missing_ocr") > 0, "ocr")
             .when((_c("missing_translation") > 0) & F.lit(translate), "translation"))
    return (pages.join(facts, "image_id", "left").withColumn("start_stage", start)
            .select("project_id", "image_id", "start_stage",
                    F.when(_c("start_stage").isNotNull(), end).alias("end_stage"),
                    *[F.when(_c("start_stage").isNotNull(), F.coalesce(n, F.lit(0))).cast("bigint").alias(n)
                      for n in ("selected", "stale")]))


def page_detail(regions: DataFrame, versions: DataFrame, offset: int, limit: int) -> DataFrame:
    """One slice of each page's regions, fenced by the version the reader holds."""
    order = [_c("reading_order"), _c("region_id")]
    current = versions.where("expected_version = current_version").select("image_id")
    fenced = regions.join(current, "image_id", "left_semi")
    placed = ranking.ranked(fenced, ["image_id"], order, _c("reading_order"), total="matched")
    after = F.lit(offset + limit)
    return (placed.where(_c("position").between(offset + 1, offset + limit))
            .withColumn("next_offset", F.when(after < _c("matched"), after).cast("bigint")))


def confirmed_free_text_report(regions: DataFrame) -> DataFrame:
    from pageloom.operators.quality import confirmed_free_text
    return regions.withColumn("free_text", confirmed_free_text(
        _c("bubble_id"), _c("role_label"), _c("label"), _c("assignment_status")))


def correction_allowed(runs: DataFrame, tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """May a run's pages be corrected: nothing active and no text work left.

    A page whose task failed or was cancelled no longer blocks on its request.
    """
    state = tasks.groupBy("image_id").agg(
        F.bool_or(_c("status").isin(*ACTIVE)).alias("_active"),
        F.bool_or(_c("status").isin("FAILED", "CANCELLED")).alias("_over"))
    wanting = requests.where("start_stage is not null").select("image_id", F.lit(True).alias("_wants"))
    no = lambda name: F.coalesce(name, F.lit(False))
    return (runs.join(state, "image_id", "left").join(wanting, "image_id", "left").groupBy("run_id").agg(
        F.bool_or(no("_active")).alias("active"), F.bool_or(no("_wants") & ~no("_over")).alias("text_pending"))
        .withColumn("allowed", ~_c("active") & ~_c("text_pending")))


def delivery_blockers(reviews: DataFrame, tasks: DataFrame, rendered: DataFrame, drifted: DataFrame,
                      now_us: int) -> DataFrame:
    """(run_id, image_id, reason) for every page that stops a delivery."""
    active = tasks.where(_c("status").isin(*ACTIVE)).groupBy("image_id").agg(F.lit(True).alias("_active"))
    joined = (reviews.join(active, "image_id", "left")
              .join(rendered.select("image_id", "current"), "image_id", "left")
              .join(drifted.select("run_id").distinct().withColumn("_drift", F.lit(True)), "run_id", "left"))
    fresh = _c("outcome").isNotNull() & (_c("reviewed_version") == _c("current_version"))
    reasons = [
        F.when(_c("lease_expires_us") > now_us, F.lit("leased")),
        F.when(_c("correction_open"), F.lit("correction_open")),
        F.when(~fresh, F.lit("review_missing_or_stale")),
        F.when(fresh & (_c("outcome") == "issues") & ~_c("deliver_with_issues"), F.lit("issues_undecided")),
        F.when(fresh & (_c("outcome") == "passed") & ~F.coalesce("current", F.lit(False)), F.lit("rendering_stale")),
        F.when(_c("_active"), F.lit("task_active")),
        F.when(_c("_drift"), F.lit("configuration_changed"))]
    return joined.select("run_id", "image_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
