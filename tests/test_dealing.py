"""Scan lines stay where their boxes were dealt; frames are tested by the lines of the masks alone."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import components as C
from pageloom.plans import QUERIES
from tests.conftest import SMALL

DEALT = ["m01_rasterise", "m04_union", "m05_dilate1", "m06_components", "m14_restore_area", "m16_mask_change", "m20_instance_id",
         "m21_coherent_components", "a15_glyph_integrity", "a32_mask_parity"]


@pytest.mark.parametrize("name", DEALT)
def test_no_scan_line_is_shuffled(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    lines = [s for s in shuffles if "REPARTITION_BY_NUM" not in s]
    assert any("REPARTITION_BY_NUM" in s for s in shuffles)
    assert not [s for s in lines if "y#" in s or "_p" in s], lines


RUN = "image_id bigint, mask_id bigint, y bigint, x0 bigint, x1 bigint"
FRAME = "image_id bigint, mask_id bigint, frame_id bigint, polygon array<struct<x: double, y: double>>"


def _holds(polygon, px, py):
    """Even-odd test of a pixel centre, its outline included."""
    odd = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if abs(cross) < 1e-9 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return True
        if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def _case():
    rng = random.Random(11)
    pixels = {(m, y, x) for m in range(6) for y in range(-2, 9) for x in range(-2, 12) if rng.random() < (0.35 if m else 1.0)}
    frames = [(1, m, f, [(float(rng.randrange(-4, 6)), -3.5), (float(rng.randrange(7, 14)), -3.0), (12.5, float(rng.randrange(4, 10))), (-2.5, 9.0)][:4 - f % 2])
              for m in range(5) for f in range(3)]
    frames.append((1, 0, 9, [(-5.0, -5.0), (20.0, -5.0), (20.0, 4.5), (-5.0, 4.5)]))
    frames.append((1, 0, 10, [(-5.0, 4.5), (20.0, 4.5), (20.0, 20.0), (-5.0, 20.0)]))
    return pixels, frames


def _tables(spark, pixels, frames):
    runs = spark.createDataFrame([(1, m, y, x, x + 1) for m, y, x in pixels], RUN)
    return runs, spark.createDataFrame([(i, m, f, [{"x": x, "y": y} for x, y in p]) for i, m, f, p in frames], FRAME)


def test_frames_cover_against_plain_code(spark):
    pixels, frames = _case()
    got = {r.mask_id: r.covered for r in C.frames_cover(*_tables(spark, pixels, frames)).collect()}
    want = {m: all(any(_holds(p, x + 0.5, y + 0.5) for _, k, _, p in frames if k == m) for q, y, x in pixels if q == m) for m in range(6)}
    assert got == want and set(want.values()) == {True, False}


def test_covered_components_against_plain_code(spark):
    pixels, frames = _case()
    runs, outlines = _tables(spark, pixels, frames)
    members = {}
    for r in C.components(runs).collect():
        members.setdefault((r.mask_id, r.component), []).extend((r.y, x) for x in range(r.x0, r.x1))
    got = {(r.mask_id, r.component): r.covered for r in C.covered_components(runs, outlines).collect()}
    want = {(m, c): any(all(_holds(p, x + 0.5, y + 0.5) for y, x in held) for _, k, _, p in frames if k == m) for (m, c), held in members.items()}
    assert got == want


def test_support_counts_every_component(spark):
    a = spark.createDataFrame([(1, 1, 0, 0, 4), (1, 1, 5, 0, 4), (1, 2, 0, 0, 4)], RUN)
    b = spark.createDataFrame([(1, 7, 0, 2, 9), (1, 7, 5, 3, 9), (1, 8, 1, 0, 9)], RUN)
    got = {(r.mask_id, r.other_id): r.supported for r in C.components_supported(a, b).collect()}
    assert got == {(1, 7): False, (2, 7): True}


def test_touching_pieces_are_one_component(spark):
    runs = [(1, 1, 0, 0, 6, "evidence"), (1, 1, 0, 0, 3, "kept"), (1, 1, 0, 3, 4, "kept"), (1, 1, 4, 0, 5, "evidence"), (1, 1, 4, 0, 2, "kept"), (1, 1, 4, 3, 5, "kept")]
    r = C.integrity(spark.createDataFrame(runs, RUN + ", layer string")).first()
    assert (r.retention, r.min_component_retention, r.clipped, r.fragmented, r.missing) == (round(8 / 11, 4), round(4 / 6, 4), 3, 1, 0)


def test_focus_windows_send_boxes_once(spark):
    plan = QUERIES["t03_focus_windows"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
