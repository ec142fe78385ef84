"""Rules that derive or edit region columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import text as X

_c = F.col

# Fixed values -----------------------------------------------------------
RUNNING_STATUS = {"detection": "DETECTING", "ocr": "OCR_RUNNING", "translation": "TRANSLATING", "mask": "MASK_GENERATING",
                  "inpainting": "INPAINTING", "rendering": "RENDERING"}
PREVIOUS_STATUS = {"detection": "UPLOADED", "ocr": "DETECTED", "translation": "OCR_DONE", "mask": "TRANSLATED",
                   "inpainting": "MASK_GENERATING", "rendering": "INPAINTED"}
ANGLE_VERSION = 2
# ------------------------------------------------------------------------


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair]), key)


def stable_status_before(stage: Column, status: Column) -> Column:
    """The status to fall back to when a running stage was interrupted."""
    return F.when(status == _lookup(RUNNING_STATUS, stage), _lookup(PREVIOUS_STATUS, stage)).otherwise(status)


def padding(uniform: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """Four margins: own side, else the uniform value, else 3; null when any is outside 0-50."""
    sides = {n: F.coalesce(v, uniform, F.lit(3.0)) for n, v in
             (("top", top), ("bottom", bottom), ("left", left), ("right", right))}
    ok = F.lit(True)
    for v in sides.values():
        ok = ok & v.between(0, 50)
    return F.when(ok, F.struct(*[v.alias(n) for n, v in sides.items()]))


def auto_font_size(explicit: Column, recorded: Column, size: Column) -> Column:
    """An explicit choice wins; otherwise a recorded size that differs proves a manual one."""
    return F.coalesce(explicit, ~F.coalesce(F.abs(recorded - size) > 0.01, F.lit(False)))


def effective_rotation(rotation: Column, perspective: Column, source: Column, role: Column, version: Column, angle: Column) -> Column:
    """Zero when a perspective frame already carries the detected angle."""
    detected = ((source == "detector") & (role == "free_text")) | ((version == 2) & source.isin("detector", "segmentation"))
    own = F.coalesce(perspective & detected & (F.abs(angle - rotation) <= 0.01), F.lit(False))
    return F.when(own, 0.0).otherwise(rotation)


def free_text_angle(confirmed: Column, angle: Column) -> Column:
    return F.when(confirmed & (F.abs(angle) <= 45), angle)


def can_initialise_rotation() -> Column:
    """May detection set the first text angle of this region?"""
    c = _c
    taken = (F.coalesce(c("role_label") == "dialogue", F.lit(False)) | F.coalesce(c("assignment_status") == "assigned", F.lit(False))
             | c("has_rotation_source") | c("locked") | c("perspective_warp") | c("bubble_id").isNotNull() | (F.abs(c("rotation")) > 0.01))
    same = (c("translated_polygon").isNull() | (c("translated_polygon") == c("polygon"))) & (
        c("translated_box").isNull() | (c("translated_box") == c("box")))
    return ~taken & same


def lease_live(expires_us: Column, now_us: int) -> Column:
    return F.coalesce(expires_us > now_us, F.lit(False))


def evidence_fresh(created_us: Column, now_us: int, version: Column, current: Column, available: Column) -> Column:
    """Younger than a day, of this version and still stored."""
    return (created_us >= now_us - 24 * 3600 * 1_000_000) & (version == current) & available


def normalise_frames(df: DataFrame) -> DataFrame:
    """Fill each missing box or polygon from its counterpart; the target falls back to the source.

    Columns: box struct<x,y,w,h>, polygon, translated_box, translated_polygon.
    ``problem`` names the first invalid frame.
    """
    def to_polygon(b: Column) -> Column:
        return F.when(b.isNotNull(), G.box_to_polygon(b["x"], b["y"], b["w"], b["h"]))
    box = F.coalesce("box", G.polygon_to_box(_c("polygon")))
    polygon = F.coalesce("polygon", to_polygon(_c("box")))
    step = df.withColumn("_b", box).withColumn("_p", polygon)
    tbox = F.coalesce("translated_box", G.polygon_to_box(_c("translated_polygon")), "_b")
    tpoly = F.coalesce("translated_polygon", to_polygon(_c("translated_box")), "_p")
    step = step.withColumn("translated_box", tbox).withColumn("translated_polygon", tpoly).withColumn("box", _c("_b")).withColumn(
        "polygon", _c("_p")).drop("_b", "_p")
    flat = lambda b: _c(b).isNull() | (F.least(_c(b)["w"], _c(b)["h"]) <= 0)
    return step.withColumn("problem", F.when(flat("box"), "box").when(G.invalid_reason(_c("polygon")).isNotNull(), "polygon")
                           .when(flat("translated_box"), "translated_box")
                           .when(G.invalid_reason(_c("translated_polygon")).isNotNull(), "translated_polygon"))


def region_update(rows: DataFrame) -> DataFrame:
    """Apply patches (``p_*`` columns, null = untouched) with their derived effects.

    A changed source frame drops its balloon, mask and repair and marks OCR
    stale; new source text confirms the frame; any target edit ends a pending
    geometry sync.
    """
    c = _c
    box = F.coalesce("p_box", F.when(c("p_polygon").isNotNull(), G.polygon_to_box(c("p_polygon"))), "box")
    polygon = F.coalesce("p_polygon", F.when(c("p_box").isNotNull(), G.box_to_polygon(
        c("p_box")["x"], c("p_box")["y"], c("p_box")["w"], c("p_box")["h"])), "polygon")
    moved = (c("p_box").isNotNull() | c("p_polygon").isNotNull()) & (~box.eqNullSafe(c("box")) | ~polygon.eqNullSafe(c("polygon")))
    said = c("p_source_text").isNotNull()
    stale = F.when(said, X.strip(c("p_source_text")) == "").when(moved, True).otherwise(c("ocr_geometry_stale"))
    target = F.coalesce("p_translated_text", "translated_text")
    old_text = (F.when(c("p_translated_text").isNotNull(), False)
                .when(said & (c("p_source_text") != c("source_text")), X.strip(target) != "").otherwise(c("translation_stale")))
    aimed = c("p_translated_box").isNotNull() | c("p_rotation").isNotNull()
    clear = lambda n: F.when(moved, F.lit(None)).otherwise(c(n)).alias(n)
    keep = [n for n in ("image_id", "region_id") if n in rows.columns]
    return rows.select(
        *keep, box.alias("box"), polygon.alias("polygon"), F.coalesce("p_source_text", "source_text").alias("source_text"),
        target.alias("translated_text"), F.coalesce("p_translated_box", "translated_box").alias("translated_box"),
        F.coalesce("p_rotation", "rotation").alias("rotation"), clear("bubble_id"), clear("mask_path"), clear("inpainted_path"),
        (c("manual") | moved).alias("manual"), stale.alias("ocr_geometry_stale"), old_text.alias("translation_stale"),
        F.when(aimed, False).when(moved, True).otherwise(c("sync_pending")).alias("sync_pending"),
        F.when(aimed, "manual_translation").when(moved, "source_to_translated").otherwise(c("sync_direction")).alias("sync_direction"))


def sync_target_from_source(rows: DataFrame) -> DataFrame:
    """After a repair: copy the source frame to the target unless the target is authored."""
    c = _c
    manual = (c("target_state") == "manual") | (c("rotation_source") == "user") | c("perspective_warp") | c("locked")
    manual = F.coalesce(manual, F.lit(False))
    copy = c("pending") & ~manual & ~c("automatic_current")
    direction = (F.when(copy, "source_to_translated").when(c("pending") & manual, "manual_translation")
                 .otherwise(F.coalesce("sync_direction", F.lit("source_to_translated"))))
    return rows.select("image_id", "region_id", F.when(copy, c("box")).otherwise(c("translated_box")).alias("translated_box"),
                       F.when(copy, False).otherwise(c("perspective_warp")).alias("perspective_warp"),
                       (c("revision") + F.when(copy, 1).otherwise(0)).alias("revision"), direction.alias("direction"))


def sync_source_from_target(rows: DataFrame) -> DataFrame:
    """Before a repair asked for in the target view: adopt the target frame as source."""
    c = _c
    changed = ~F.coalesce("translated_box", "box").eqNullSafe(c("box"))
    act = changed | c("pending")
    return rows.select("image_id", "region_id", F.when(act, F.coalesce("translated_box", "box")).otherwise(c("box")).alias("box"),
                       (c("revision") + F.when(act, 1).otherwise(0)).alias("revision"), changed.alias("changed"),
                       F.when(act, "translated_to_source").otherwise(c("sync_direction")).alias("direction"))


def typography_patch(rows: DataFrame, fresh: bool = False) -> DataFrame:
    """What recognised lettering may change: nothing, state only, or frame, angle and direction.

    ``pristine`` says the target frame still equals the source frame, and
    ``managed`` that it still equals the last automatic one.
    """
    c = _c
    moved = F.coalesce(c("evidence_geometry") != c("geometry"), F.lit(False))
    own = F.coalesce((c("rotation_source") == "user") | (c("target_state") == "manual"), F.lit(False))
    automatic = F.coalesce(c("target_state") == "auto", F.lit(False))
    held = F.lit(fresh) | c("target_state").isNotNull()
    open_ = (c("managed") & automatic) | (c("pristine") & (F.abs(c("rotation")) <= 0.01) & (F.lit(fresh) | automatic))
    gate = (F.when(c("evidence_status").isNull(), "none").when(moved, "geometry_changed")
            .when(c("locked") | c("perspective_warp"), "protected").when(c("evidence_version") != ANGLE_VERSION, "old_version")
            .when(~held, "untracked").when(own | ~open_, "authored")
            .when(~c("evidence_status").isin("accepted", "upright"), "uncertain")
            .when((c("angle") != 0) & ~c("has_frame"), "no_frame").otherwise("apply"))
    g = rows.withColumn("decision", gate)
    reached = c("decision").isin("apply", "no_frame")
    turn = c("decision") == "apply"
    return g.select(
        "image_id", "region_id", "decision",
        F.when(reached & c("orientation_confident") & (F.coalesce("orientation_state", F.lit("auto")) == "auto"),
               c("evidence_orientation")).alias("orientation"),
        F.when(turn & (c("angle") != 0), c("angle")).when(turn & c("managed") & automatic, 0.0).alias("rotation"),
        F.when(turn & (c("angle") != 0), "evidence_frame").when(turn & c("managed") & automatic, "source_frame").alias("frame"))


def source_crop_angle() -> Column:
    """The angle valid for exactly this outline; detection's only while not hand-edited."""
    c = _c
    return F.when((c("frame_polygon") == c("polygon")) & c("frame_angle").isNotNull(), c("frame_angle")).when(
        c("manual"), F.lit(None).cast("double")).otherwise(c("detected_angle"))


def carry_frame(before: Column, after: Column) -> Column:
    """Angle of the edited frame's own top edge, following vertex correspondence; null unless both are quads."""
    old = G.order_quad(before)
    first = G.let(old, lambda q: F.when(q.isNotNull(), F.struct(
        F.array_position(before, F.get(q, F.lit(0))).alias("a"), F.array_position(before, F.get(q, F.lit(1))).alias("b"))))

    def angle(at: Column) -> Column:
        p, q = F.get(after, (at["a"] - 1).cast("int")), F.get(after, (at["b"] - 1).cast("int"))
        return F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))
    return F.when(old.isNotNull() & G.order_quad(after).isNotNull(), G.let(first, angle))


def unique_key(keys: DataFrame) -> DataFrame:
    """Make ``region_key`` unique per page: the first keeps it, later ones take ``-2``, ``-3``...

    A numbered name that another row already owns is skipped, so names are
    settled in arrival order by a fold whose state is the page's used names.
    """
    from pageloom.core.fold import ordered_fold

    def step(state, row):
        image, seq, key = row
        name = key
        if key in state:
            n = state[key]
            while name in state:
                n += 1
                name = f"{key[:20]}-{n}"
            state[key] = n
        state[name] = state.get(name, 1)
        yield image, seq, name
    return ordered_fold(keys.select("image_id", "seq", "region_key"), ["image_id"], ["seq"], dict, step,
                        "image_id bigint, seq bigint, unique_key string")
