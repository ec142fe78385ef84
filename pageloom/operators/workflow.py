"""Review planning: tiles, next actions, checks and publication rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.fold import clustered_fold
from pageloom.functions import text as X
from pageloom.operators.areas import union_area

_c = F.col
REVIEW_STAGES = ("preflight_review", "final_review", "stale_review", "delivery_decision")
PAGE_OUTPUTS = ("clean_path", "rendered_path", "text_layer_path", "metadata_json", "status", "current_stage", "error_message")


def spatial_sort(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy("image_id", "y", F.desc("x"), "label", "region_id")


def paginate(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page of rows with ``next_offset``, null on the last page."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    more = F.max("_n").over(Window.partitionBy(F.lit(0))) > limit
    return numbered.withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("bigint"))).where(
        _c("_n") <= limit).drop("_n")


def focus_windows(boxes: DataFrame, limit: int = 6, tile: int = 384, side: int = 512, margin: int = 32) -> DataFrame:
    """Up to ``limit`` inspection windows per page, smallest text first.

    ``boxes``: image_id, x, y, w, h, width, height.  Tiling is declarative;
    skipping a centre an earlier window already shows is a fold whose state is
    the few windows chosen so far.
    """
    c = _c
    valid = boxes.where("w > 0 and h > 0 and x < width and y < height and x + w > 0 and y + h > 0").select(
        "image_id", F.greatest(F.lit(0.0), c("x")).alias("l"), F.greatest(F.lit(0.0), c("y")).alias("t"),
        F.least(c("width"), c("x") + c("w")).alias("r"), F.least(c("height"), c("y") + c("h")).alias("b"), "width", "height")
    parts = lambda lo, hi: F.greatest(F.lit(1), F.ceil((c(hi) - c(lo)) / tile))
    tiles = (valid.withColumn("nx", parts("l", "r")).withColumn("ny", parts("t", "b"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), c("ny") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(0), c("nx") - 1))))
    centre = lambda lo, hi, k, n, page: F.least(c(page) - 1, F.greatest(
        F.lit(0.0), c(lo) + (c(hi) - c(lo)) * (c(k) + 0.5) / c(n)))
    small = F.least(c("r") - c("l"), c("b") - c("t"))
    points = tiles.select("image_id", small.alias("small"), c("t").alias("top"), c("l").alias("left"), "j", "i",
                          centre("l", "r", "i", "nx", "width").cast("double").alias("cx"),
                          centre("t", "b", "j", "ny", "height").cast("double").alias("cy"),
                          c("width").cast("bigint").alias("pw"), c("height").cast("bigint").alias("ph")).distinct()

    def step(state, row):
        image, *_, cx, cy, pw, ph = row
        if len(state) >= limit or any(x + margin <= cx <= x + w - margin and y + margin <= cy <= y + h - margin
                                      for x, y, w, h in state):
            return
        w, h = min(side, pw), min(side, ph)
        spot = (min(pw - w, max(0, int(cx - w / 2))), min(ph - h, max(0, int(cy - h / 2))), w, h)
        if spot not in state:
            state.append(spot)
            yield image, len(state), *spot
    return clustered_fold(points, ["image_id"], ["small", "top", "left", "j", "i"], list, step,
                          "image_id bigint, n bigint, x bigint, y bigint, w bigint, h bigint", len(points.columns))


def review_tiles(pages: DataFrame, evidence: DataFrame, max_side: int = 1600, max_scale: float = 2,
                 max_tiles: int = 256) -> DataFrame:
    """Overlapping crops still to be looked at; a null crop marks a page over the tile limit.

    ``evidence``: image_id, x, y, w, h, scale.
    """
    seen = evidence.where(_c("scale") <= max_scale).select("image_id", "x", "y", "w", "h")
    half = F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / 2))
    failed = evidence.where(_c("scale") > max_scale).groupBy("image_id").agg(F.min(half).alias("_half"))
    grid = (pages.select("image_id", "width", "height").join(failed, "image_id", "left")
            .withColumn("side", F.least(F.lit(max_side), F.coalesce("_half", F.lit(max_side))))
            .withColumn("step", F.greatest(F.lit(1), _c("side") - F.floor(_c("side") / 10))))
    count = lambda page: F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), _c(page) - _c("side")) / _c("step")) + 1)
    grid = grid.withColumn("cols", count("width")).withColumn("rows", count("height"))
    at = lambda k, page: F.least(_c(k) * _c("step"), F.greatest(F.lit(0), _c(page) - _c("side")))
    lo_x, lo_y = F.greatest("x", "tx"), F.greatest("y", "ty")
    hi_x, hi_y = F.least(_c("x") + _c("w"), _c("tx") + _c("tw")), F.least(_c("y") + _c("h"), _c("ty") + _c("th"))
    # a crop meets the tiles of its own index range (and the last ones, which are moved inside), not all of the page
    reach = lambda low, size, n: F.array_union(F.sequence(
        F.least(_c(n) - 1, F.greatest(F.lit(0), F.floor((_c(low) - _c("side")) / _c("step")))),
        F.least(_c(n) - 1, F.greatest(F.lit(0), F.floor((_c(low) + _c(size)) / _c("step"))))), F.array(_c(n) - 1))
    met = (seen.join(grid.where(_c("cols") * _c("rows") <= max_tiles), "image_id")
           .withColumn("j", F.explode(reach("y", "h", "rows"))).withColumn("i", F.explode(reach("x", "w", "cols")))
           .withColumn("tx", at("i", "width")).withColumn("ty", at("j", "height"))
           .withColumn("tw", F.least("side", _c("width") - _c("tx"))).withColumn("th", F.least("side", _c("height") - _c("ty"))))
    clipped = met.where((hi_x > lo_x) & (hi_y > lo_y)).select(
        "image_id", "tx", "ty", lo_x.alias("x"), lo_y.alias("y"), (hi_x - lo_x).alias("w"), (hi_y - lo_y).alias("h"))
    covered = union_area(clipped, ["image_id", "tx", "ty"])
    # a page's covered tiles, as many as the limit at most, travel as one row
    tile = _c("tx").cast("bigint") * 4294967296 + _c("ty")
    known = covered.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(tile, "area"))).alias("_areas"))
    tiles = (grid.where(_c("cols") * _c("rows") <= max_tiles).join(known, "image_id", "left")
             .withColumn("j", F.explode(F.sequence(F.lit(0), _c("rows") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(0), _c("cols") - 1)))
             .select("image_id", at("i", "width").alias("tx"), at("j", "height").alias("ty"), "side", "width", "height", "_areas")
             .withColumn("tw", F.least("side", _c("width") - _c("tx")))
             .withColumn("th", F.least("side", _c("height") - _c("ty"))))
    open_ = (tiles.where(F.coalesce(_c("_areas")[tile], F.lit(0)) < _c("tw") * _c("th"))
             .select("image_id", "tx", "ty", "tw", "th", F.lit(False).alias("blocked")))
    none = F.lit(None).cast("bigint")
    over = grid.where(_c("cols") * _c("rows") > max_tiles).select(
        "image_id", none.alias("tx"), none.alias("ty"), none.alias("tw"), none.alias("th"), F.lit(True).alias("blocked"))
    return open_.unionByName(over)


def page_stage(facts: DataFrame) -> DataFrame:
    """The stage label of every page of a run, from its boolean facts."""
    c = _c
    undecided = (c("final_outcome") == "issues") & ~c("final_deliver")
    settled = c("final_current") & ~c("correction_open")
    stage = (
        F.when(c("page_missing"), "page_deleted").when(c("configuration_stale"), "configuration_changed")
        .when(c("has_active"), F.when(c("has_paused"), "paused").otherwise("waiting"))
        .when(settled & undecided & (c("rounds") < 2), "correction_available")
        .when(settled & undecided & c("batch"), "delivery_decision")
        .when(settled, "ready_for_delivery")
        .when(c("latest_status").isin("FAILED", "CANCELLED"), F.lower("latest_status"))
        .when(c("batch") & c("correction_open") & c("problem_review_current"), "correcting")
        .when(c("rendered_current") & ~c("stale_translation") & c("repair_ready"), "final_review")
        .when(c("final_present") & ~c("correction_open"),
              F.when((c("rounds") < 2) & c("preflight_at_version") & (c("preflight_outcome") == "issues"),
                     "correction_available").otherwise("stale_review"))
        .when(c("batch") & c("text_start").isNotNull(), c("text_start"))
        .when(c("batch") & c("agent_mode") & c("untranslated"), "agent_translation")
        .when(c("batch") & ~c("text_checked"), "preflight_review")
        .when(c("batch") & (F.coalesce("preflight_outcome", F.lit("")) != "passed"),
              F.when(c("correction_open"), "preflight_review").when(c("rounds") < 2, "correction_available")
              .otherwise("preflight_unresolved"))
        .when((c("row_count") == 0) & ~c("detection_done"), "detection")
        .when(~c("preflight_current"), F.when(c("layout_only"), "rendering").when(c("missing_ocr"), "ocr")
              .otherwise("preflight_review"))
        .when(c("restores") & ~c("pending_repair"), "inpainting")
        .when(c("selected") == 0, "rendering")
        .when(c("untranslated"), F.when(c("agent_mode"), "agent_translation").otherwise("translation"))
        .when(c("mask_missing"), "mask")
        .when(~c("clean_present") | c("pending_repair"), "inpainting")
        .otherwise("rendering"))
    return facts.withColumn("stage", stage)


def next_action(staged: DataFrame, group: int = 20) -> DataFrame:
    """Pages each run should handle next: one batch group, or its first page of the best class.

    ``staged``: run_id, image_id, order_index, stage, text_only, has_active,
    output_started, initial_phase.  Order of preference: text, agent
    translation, started output, reviews, editing, corrections, output.
    """
    c = _c
    process = c("stage").isin("detection", "ocr", "translation", "mask", "inpainting", "rendering")
    kind = (F.when(process & c("text_only"), "text").when(process, "output").when(c("stage").isin(*REVIEW_STAGES), "review")
            .when(c("stage") == "correction_available", "correction").when(c("stage") == "agent_translation", "agent")
            .when(c("stage") == "correcting", "editing"))
    kinds = staged.withColumn("kind", kind)
    run = kinds.groupBy("run_id").agg(
        F.bool_or("has_active").alias("_active"),
        F.bool_or(F.coalesce(c("kind").isin("text", "agent"), F.lit(False)) | c("has_active")).alias("_texty"),
        F.bool_or("initial_phase").alias("_initial"), F.bool_or("output_started").alias("_started"))
    joined = kinds.join(run, "run_id")
    rank = (F.when(c("kind") == "text", 1).when(c("kind") == "agent", 2).when((c("kind") == "output") & c("_started"), 3)
            .when(c("kind") == "review", 4).when((c("kind") == "editing") & ~c("_active"), 5)
            .when((c("kind") == "correction") & ~c("_active"), 6)
            .when((c("kind") == "output") & ~(c("_initial") & c("_texty")), 7)
            .when(c("stage") != "ready_for_delivery", 8))
    ranked = joined.withColumn("priority", rank).where("priority is not null")
    best = ranked.groupBy("run_id").agg(F.min("priority").alias("_best"))
    turn = Window.partitionBy("run_id").orderBy("order_index", "image_id")
    chosen = ranked.join(best, "run_id").where("priority = _best").withColumn("place", F.row_number().over(turn)).where(
        c("place") <= group)
    return chosen.where(c("kind").isin("text", "output") | (c("place") == 1)).select(
        "run_id", "image_id", "stage", "priority", "place")


def suppress(predictions: DataFrame, fragments: DataFrame, covered: DataFrame, partitions: DataFrame,
             children: DataFrame) -> DataFrame:
    """Surviving predictions; a partitioned parent is replaced by its pieces.

    ``partitions``: image_id, region_id (parent), piece_no, x, y, w, h.
    """
    keys = ["image_id", "region_id"]
    gone = fragments.select(*keys).union(covered.select(*keys)).union(children.select(*keys)).union(
        partitions.select(*keys)).distinct()
    whole = predictions.join(gone, keys, "left_anti").select(*keys, F.lit(0).cast("bigint").alias("piece_no"), "x", "y", "w", "h")
    hidden = fragments.select(*keys).union(covered.select(*keys)).union(children.select(*keys)).distinct()
    pieces = partitions.join(hidden, keys, "left_anti").select(*keys, "piece_no", "x", "y", "w", "h")
    return whole.unionByName(pieces)


def preserved_conflicts(regions: DataFrame, allowed: DataFrame, preserved: DataFrame, scope: DataFrame) -> DataFrame:
    """(image_id, region_id, problem) for every broken preflight selection rule."""
    keys = ["image_id", "region_id"]
    flag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    rows = regions.select(*keys, "locked", "region_type", "mask_pixels", "created_by_run",
                          (_c("visible") & (X.strip(_c("translated_text")) != "")).alias("_shown"), F.lit(True).alias("_exists"))
    marked = rows
    for df, n in ((allowed, "_allowed"), (preserved, "_kept"), (scope, "_scope")):
        marked = marked.join(flag(df, n), keys, "full" if n != "_scope" else "left")
    on = lambda n: F.coalesce(n, F.lit(False))
    sfx = _c("region_type") == "sfx"
    found = [
        F.when(on("_allowed") & (_c("_exists").isNull() | on("locked")), "not_unlocked"),
        F.when(on("_allowed") & ~on("_scope") & ~on("created_by_run"), "outside_scope"),
        F.when(on("_kept") & _c("_exists").isNull(), "unknown_preserved"),
        F.when(on("_kept") & on("_allowed"), "preserved_and_allowed"),
        F.when(on("_allowed") & sfx, "sfx_allowed"),
        F.when(sfx & ~on("_kept"), "sfx_not_preserved"),
        F.when(on("_kept") & (_c("mask_pixels") > 0), "preserved_has_mask"),
        F.when(on("_kept") & on("_shown"), "preserved_has_text")]
    return marked.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def pair_requests(requests: DataFrame) -> DataFrame:
    """One comparison where a crop is wanted both as original and as rendered."""
    return requests.groupBy("image_id", "x", "y", "w", "h").agg(
        F.when(F.count_if(_c("kind") == "original") * F.count_if(_c("kind") == "rendered") > 0, "comparison")
        .otherwise(F.min("kind")).alias("kind"))


def evidence_views(evidence: DataFrame, kind: str) -> DataFrame:
    """Crops that show ``kind``: its own images and matching panels of comparisons.

    ``evidence``: image_id, evidence_id, kind, crop, panels array<struct<kind, crop>>.
    """
    panels = evidence.where("kind = 'comparison'").select(
        "image_id", "evidence_id", F.explode("panels").alias("_p")).where(_c("_p.kind") == kind).select(
        "image_id", "evidence_id", _c("_p.crop").alias("crop"))
    plain = evidence.where((_c("kind") == kind) | (F.lit(kind == "original") & (_c("kind") == "annotated")))
    return panels.unionByName(plain.select("image_id", "evidence_id", "crop"))


def required_checks(supplied: DataFrame, expected: Sequence[str], outcomes: DataFrame, issues: DataFrame) -> DataFrame:
    """Review verdict per page: exact check set, and nothing open when passed.

    ``supplied``: image_id, check, passed.
    """
    known = _c("check").isin(*expected)
    seen = supplied.groupBy("image_id").agg(
        F.countDistinct(F.when(known, _c("check"))).alias("_known"), F.count_if(~known).alias("_extra"),
        F.bool_and("passed").alias("_all"))
    open_ = issues.where(_c("status").isin("open", "uncertain", "unverified")).groupBy("image_id").agg(F.lit(True).alias("_open"))
    complete = (F.coalesce("_known", F.lit(0)) == len(expected)) & (F.coalesce("_extra", F.lit(0)) == 0)
    passed = _c("outcome") == "passed"
    return (outcomes.join(seen, "image_id", "left").join(open_, "image_id", "left").select(
        "image_id", F.when(~complete, "checks_incomplete").when(passed & ~F.coalesce("_all", F.lit(False)), "check_not_passed")
        .when(passed & _c("_open").isNotNull(), "open_issues").otherwise("accepted").alias("verdict")))


def publication_checks(runs: DataFrame, proofs: DataFrame, changed_fields: DataFrame, deletes: DataFrame,
                       rewrites: DataFrame) -> DataFrame:
    """(run_id, problem) that forbid publishing a finished page run.

    ``runs``: run_id, stages array, clean_path, rendered_path, layer_path,
    generation, current_generation, version, current_version.
    """
    held = proofs.groupBy("run_id").agg(F.collect_set("stage").alias("_held"))  # at most one entry per stage name
    extra = changed_fields.where(~_c("field").isin(*PAGE_OUTPUTS)).groupBy("run_id").agg(F.lit(True).alias("_fields"))
    gone = deletes.groupBy("run_id").agg(F.lit(True).alias("_deletes"))
    history = rewrites.groupBy("run_id").agg(F.lit(True).alias("_history"))
    j = runs.join(held, "run_id", "left").join(extra, "run_id", "left").join(gone, "run_id", "left").join(history, "run_id", "left")
    have = F.coalesce("_held", F.array().cast("array<string>"))
    needs = lambda s: F.array_contains("stages", s)
    found = [
        F.when((F.size(F.array_except("stages", have)) > 0) | (F.size(F.array_except(have, "stages")) > 0), "stage_proofs"),
        F.when((needs("inpainting") & _c("clean_path").isNull())
               | (needs("rendering") & (_c("rendered_path").isNull() | _c("layer_path").isNull())), "image_missing"),
        F.when(_c("_fields"), "page_field_changed"),
        F.when(_c("_deletes") & ~needs("detection"), "delete_without_detection"),
        F.when(_c("_history"), "history_rewritten"),
        F.when(_c("generation") != _c("current_generation"), "superseded"),
        F.when(_c("version") != _c("current_version"), "page_changed")]
    return j.select("run_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))
