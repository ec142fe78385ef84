"""Connected components of run tables and the checks built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.intervals import layers, merge_runs, stacked
from pageloom.operators.masks import LINE, MASK, pixels

_c = F.col


PARTS = "y", "x0", "x1"


def _owners(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each element of a column of lists its row, and the elements."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), lists.flatten()


def _numbers(structs: pa.Array, *names: str) -> list[np.ndarray]:
    return [structs.field(n).to_numpy(zero_copy_only=False) for n in names]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links a - b."""
    parent = np.arange(n)
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return parent


def _numbered(mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Component of each run, sorted by mask, y and x0: the place in its mask of the component's first maximal run.

    A run touches its neighbours on the line, and those of the line above within one pixel.
    """
    n = len(y)
    if not n:
        return y
    edges = np.unique(np.concatenate([x0, x1]))
    x0, x1, span = np.searchsorted(edges, x0), np.searchsorted(edges, x1), len(edges) + 1
    same = np.r_[False, mask[1:] == mask[:-1]]
    on_line = same & np.r_[False, y[1:] == y[:-1]]
    line = np.cumsum(~on_line)
    touching = on_line & np.r_[False, x0[1:] <= x1[:-1]]
    first = np.flatnonzero(~on_line)
    below = (same & np.r_[False, y[1:] == y[:-1] + 1])[first][line - 1]
    low = np.searchsorted(line * span + x1, (line - 1) * span + x0)
    high = np.searchsorted(line * span + x0, (line - 1) * span + x1, side="right")
    count = np.where(below, np.maximum(high - low, 0), 0)
    lower = np.repeat(np.arange(n), count)
    upper = np.arange(len(lower)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    beside = np.flatnonzero(touching)
    root = _roots(n, np.r_[lower, beside], np.r_[upper, beside - 1])
    place = np.cumsum(~touching) - 1
    start = place[np.flatnonzero(~same)][np.cumsum(~same) - 1]
    return place[root] - start


def _labels(parts: Column, flag: str | None = None) -> Column:
    """Component of each run of a column of sorted runs; null for runs without ``flag``."""
    @F.arrow_udf("array<bigint>")
    def label(rows: pa.Array) -> pa.Array:
        mask, runs = _owners(rows)
        on = np.ones(len(mask), bool) if flag is None else _numbers(runs, flag)[0].astype(bool)
        out = np.zeros(len(mask), np.int64)
        out[on] = _numbered(mask[on], *[v[on] for v in _numbers(runs, *PARTS)])
        starts = np.searchsorted(mask, np.arange(len(rows) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(out, mask=~on))
    return label(parts)


def _packed(runs: DataFrame, *flags: str) -> DataFrame:
    """One row per mask with its sorted runs: at most half a run per pixel of one page image, whatever the size of the corpus."""
    part = F.struct(*[_c(n).cast("bigint").alias(n) for n in PARTS], *flags)
    return runs.groupBy(*MASK).agg(F.sort_array(F.collect_list(part)).alias("parts"))


def _spread(packed: DataFrame, **labels: Column) -> DataFrame:
    """The runs of packed masks with their labels, one row each."""
    rows = packed.select(*MASK, "parts", *[c.alias(n) for n, c in labels.items()])
    rows = rows.select(*MASK, F.explode(F.arrays_zip("parts", *labels)).alias("_p"))
    return rows.select(*MASK, "_p.parts.*", *[_c("_p")[n].alias(n) for n in labels])


def components(runs: DataFrame) -> DataFrame:
    """Runs with an 8-connected ``component`` label, numbered by first run."""
    return _spread(_packed(merge_runs(runs, LINE)), component=_labels(_c("parts")))


def _box() -> list[Column]:
    return [F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") + 1 - F.min("y")).alias("h")]


def component_boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*MASK, "component").agg(pixels().alias("area"), *_box())


SLACK = 1e-6


def _inside(row: np.ndarray, runs: pa.Array, polygons: pa.Array) -> np.ndarray:
    """Pixels of each run whose centre lies in or on one of the polygons of its row (slack 1e-6).

    ``polygons`` holds a list of outlines per row, ``row`` the row of each run.
    """
    y, left, right = _numbers(runs, *PARTS)
    held = np.zeros(len(y), np.int64)
    ring_row, rings = _owners(polygons)
    ring, points = _owners(rings)
    if not len(y) or not len(ring):
        return held
    ax, ay = [v.astype(float) for v in _numbers(points, "x", "y")]
    # the next corner, the first one after the last
    last = np.r_[ring[1:] != ring[:-1], True]
    following = np.arange(1, len(ring) + 1)
    following[last] = np.flatnonzero(np.r_[True, last[:-1]])
    bx, by = ax[following], ay[following]
    # every run with every edge of its row
    edge_row = ring_row[ring]
    from_, to = np.searchsorted(edge_row, row), np.searchsorted(edge_row, row, side="right")
    run = np.repeat(np.arange(len(y)), to - from_)
    edge = np.arange(len(run)) - np.repeat(np.cumsum(to - from_) - (to - from_), to - from_) + np.repeat(from_, to - from_)
    line, ay_, by_, ax_, bx_ = y[run], ay[edge], by[edge], ax[edge], bx[edge]
    cross = (ay_ != by_) & (line >= np.ceil(np.minimum(ay_, by_) - 0.5)) & (line <= np.ceil(np.maximum(ay_, by_) - 0.5) - 1)
    c_run, c_edge = run[cross], edge[cross]
    at = ax[c_edge] + (y[c_run] + 0.5 - ay[c_edge]) * (bx[c_edge] - ax[c_edge]) / (by[c_edge] - ay[c_edge])
    order = np.lexsort((c_edge, at, ring[c_edge], c_run))
    c_run, c_ring, at = c_run[order], ring[c_edge][order], at[order]
    fresh = np.r_[True, (c_run[1:] != c_run[:-1]) | (c_ring[1:] != c_ring[:-1])][:len(c_run)]
    begin = np.flatnonzero(fresh)
    number = np.arange(len(c_run)) - begin[np.cumsum(fresh) - 1]
    opens = np.flatnonzero((number % 2 == 0) & ~np.r_[fresh[1:], True][:len(c_run)])
    flat = (np.abs(ay_ - by_) <= SLACK) & (np.abs(ay_ - 0.5 - line) <= SLACK)
    span_run = np.r_[c_run[opens], run[flat]]
    x0 = np.ceil(np.r_[at[opens], np.minimum(ax_, bx_)[flat]] - 0.5 - SLACK).astype(np.int64)
    x1 = np.floor(np.r_[at[opens + 1], np.maximum(ax_, bx_)[flat]] - 0.5 + SLACK).astype(np.int64) + 1
    # the union of each run's pieces
    x0, x1 = np.maximum(x0, left[span_run]), np.minimum(x1, right[span_run])
    some = x1 > x0
    span_run, x0, x1 = span_run[some], x0[some] - left[span_run[some]], x1[some] - left[span_run[some]]
    order = np.lexsort((x0, span_run))
    width = right - left
    base = (np.cumsum(width) - width)[span_run[order]]
    reach = np.maximum.accumulate(np.r_[0, base + x1[order]])
    np.add.at(held, span_run[order], np.maximum(0, reach[1:] - np.maximum(base + x0[order], reach[:-1])))
    return held


def covered_components(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Is each component of ``runs`` wholly inside one frame of its mask?  ``frames``: image_id, mask_id, frame_id, polygon.

    Only the scan lines of a mask's own runs are looked at, never those of the whole frame.
    """
    @F.arrow_udf("array<struct<component: bigint, covered: boolean>>")
    def judge(rows: pa.Array, polygons: pa.Array) -> pa.Array:
        mask, parts = _owners(rows)
        runs = _numbers(parts, *PARTS)
        whole = _inside(mask, parts, polygons) == runs[2] - runs[1]
        label = _numbered(mask, *runs)
        order = np.lexsort((label, mask))
        first = np.flatnonzero(np.r_[True, (np.diff(mask[order]) != 0) | (np.diff(label[order]) != 0)][:len(order)])
        good = np.logical_and.reduceat(whole[order], first) if len(first) else whole
        starts = np.searchsorted(mask[order][first], np.arange(len(rows) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(label[order][first]), pa.array(good)], ["component", "covered"])
        return pa.ListArray.from_arrays(pa.array(starts), pairs)
    outline = frames.groupBy(*MASK, "frame_id").agg(F.collect_list("polygon").alias("polygons"))
    met = _packed(merge_runs(runs, LINE)).join(outline, MASK, "left")
    return met.select(*MASK, F.explode(judge("parts", "polygons")).alias("_j")).groupBy(*MASK, "_j.component").agg(
        F.bool_or("_j.covered").alias("covered"))


def components_supported(runs: DataFrame, support: DataFrame) -> DataFrame:
    """Per (mask, other): does the other mask hold at least half of every component?

    Masks meet as wholes, by their bounds; only those that meet are labelled.
    """
    low = lambda n: F.array_min(_c("parts")[n])
    high = lambda n: F.array_max(_c("parts")[n])
    bounds = [low("y").alias("top"), high("y").alias("bottom"), low("x0").alias("left"), high("x1").alias("right")]
    a = _packed(merge_runs(runs, LINE)).select(*MASK, "parts", *bounds)
    b = _packed(support.where("x1 > x0")).select("image_id", _c("mask_id").alias("other_id"), _c("parts").alias("_other"),
                                                 *[c.alias(f"_{n}") for c, n in zip(bounds, ("top", "bottom", "left", "right"))])
    near = ((_c("top") <= _c("_bottom")) & (_c("_top") <= _c("bottom")) & (_c("left") < _c("_right")) & (_c("_left") < _c("right")))
    pairs = a.join(b, "image_id").where(near).select(*MASK, "other_id", "parts", "_other", _labels(_c("parts")).alias("component"))
    rows = pairs.select(*MASK, "other_id", "_other", F.explode(F.arrays_zip("parts", "component")).alias("_p"))
    shared = lambda r: F.least(_c("_p.parts.x1"), r["x1"]) - F.greatest(_c("_p.parts.x0"), r["x0"])
    met = F.filter("_other", lambda r: (r["y"] == _c("_p.parts.y")) & (shared(r) > 0))
    hit = rows.select(*MASK, "other_id", _c("_p.component").alias("component"), (_c("_p.parts.x1") - _c("_p.parts.x0")).alias("area"),
                      F.aggregate(met, F.lit(0).cast("bigint"), lambda s, r: s + shared(r)).alias("hit"))
    per = hit.groupBy(*MASK, "other_id", "component").agg(F.sum("hit").alias("hit"), F.sum("area").alias("area"))
    return per.groupBy(*MASK, "other_id").agg(
        F.bool_and(_c("hit") * 2 >= _c("area")).alias("supported"), F.max("hit").alias("_any")).where("_any > 0").drop("_any")


def frames_cover(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Does every pixel centre of a mask lie in at least one of its frames?"""
    @F.arrow_udf("boolean")
    def judge(rows: pa.Array, polygons: pa.Array) -> pa.Array:
        mask, parts = _owners(rows)
        runs = _numbers(parts, *PARTS)
        missed = _inside(mask, parts, polygons) < runs[2] - runs[1]
        return pa.array(np.bincount(mask[missed], minlength=len(rows)) == 0)
    outline = frames.groupBy(*MASK).agg(F.collect_list("polygon").alias("polygons"))
    met = _packed(merge_runs(runs, LINE)).join(outline, MASK, "left")
    return met.select(*MASK, judge("parts", "polygons").alias("covered"))


def keep_components(labelled: DataFrame, minimum: int = 3) -> DataFrame:
    big = component_boxes(labelled).where(_c("area") >= minimum).select(*MASK, "component")
    return labelled.join(big, [*MASK, "component"], "left_semi")


def residual(pixels: DataFrame) -> DataFrame:
    """Runs of confirmed residue: probable after, probable before, allowed, and not a speck.

    ``pixels``: image_id, mask_id, y, x, after, before, allowed.
    """
    signal = pixels.where((_c("after") >= 0.55) & (_c("before") >= 0.25) & _c("allowed")).select(
        *LINE, _c("x").alias("x0"), (_c("x") + 1).alias("x1"))
    return keep_components(components(signal))


def coherent_components(candidate: DataFrame, support: DataFrame) -> DataFrame:
    """Components with two supported pixels, and unsupported peers beside one of similar size."""
    return coherent(stacked({"candidate": candidate, "support": support}))


def coherent(runs: DataFrame) -> DataFrame:
    """``coherent_components`` over one table whose ``layer`` is candidate or support."""
    cut = layers(runs, ["candidate", "support"], LINE).where("candidate")
    marked = _spread(_packed(cut, "support"), component=_labels(_c("parts"))).groupBy(*MASK, "component").agg(
        pixels().alias("area"), *_box(), F.sum(F.when(_c("support"), _c("x1") - _c("x0")).otherwise(0)).alias("hits"))
    trusted = marked.where("hits >= 2")
    ref = trusted.select(*MASK, *[_c(n).alias("r" + n) for n in ("x", "y", "w", "h")])
    c = _c

    def peer(p: str, s: str, q: str, r: str) -> Column:
        """Side by side along q: shared extent in p, similar size, small gap."""
        shared = F.greatest(F.lit(0), F.least(c(p) + c(s), c("r" + p) + c("r" + s)) - F.greatest(c(p), c("r" + p)))
        gap = F.greatest(F.lit(0), F.greatest(c(q), c("r" + q)) - F.least(c(q) + c(r), c("r" + q) + c("r" + r)))
        return ((shared >= 0.7 * F.least(c(s), c("r" + s))) & (c(s) >= 0.6 * c("r" + s)) & (c(s) <= 1.7 * c("r" + s))
                & (gap <= 2 * F.greatest(c(s), c("r" + s))))
    alike = (marked.where("hits = 0 and area >= 3").join(ref, MASK)
             .where(peer("y", "h", "x", "w") | peer("x", "w", "y", "h")).select(*MASK, "component").distinct())
    return trusted.select(*MASK, "component", F.lit("supported").alias("why")).union(
        alike.select(*MASK, "component", F.lit("peer").alias("why")))


def glyph_integrity(evidence: DataFrame, kept: DataFrame) -> DataFrame:
    """How well ``kept`` preserves each evidence mask, component by component."""
    return integrity(stacked({"evidence": evidence, "kept": kept}))


def integrity(runs: DataFrame) -> DataFrame:
    """``glyph_integrity`` over one table whose ``layer`` is evidence or kept."""
    cut = layers(runs, ["evidence", "kept"], LINE).where("evidence")
    pieces = _spread(_packed(cut, "kept"), component=_labels(_c("parts")), piece=_labels(_c("parts"), "kept"))
    sized = pieces.groupBy(*MASK, "component", "piece").agg(pixels().alias("_n"))
    kept_n = F.when(_c("piece").isNotNull(), _c("_n"))
    per = sized.groupBy(*MASK, "component").agg(
        F.sum("_n").alias("area"), F.coalesce(F.sum(kept_n), F.lit(0)).alias("held"), F.count_if(kept_n >= 2).alias("_pieces"))
    real = _c("area") >= 3
    return per.groupBy(*MASK).agg(
        F.round(F.sum("held") / F.sum("area"), 4).alias("retention"),
        F.coalesce(F.round(F.min(F.when(real, _c("held") / _c("area"))), 4), F.lit(1.0)).alias("min_component_retention"),
        (F.sum("area") - F.sum("held")).alias("clipped"),
        F.count_if(real & (_c("_pieces") > 1)).alias("fragmented"), F.count_if(real & (_c("held") == 0)).alias("missing"))


def mask_parity(old: DataFrame, new: DataFrame, gate: float = 0.001) -> DataFrame:
    """Per page: largest changed share of a mask pair and components lost by the new masks."""
    return parity(stacked({"old": old, "new": new}), gate)


def parity(runs: DataFrame, gate: float = 0.001) -> DataFrame:
    """``mask_parity`` over one table whose ``layer`` is old or new."""
    cut = layers(runs, ["old", "new"], LINE).where("old or new")
    pieces = _spread(_packed(cut, "old", "new"), component=_labels(_c("parts"), "old"))
    both = _c("old") & _c("new")
    per = pieces.groupBy(*MASK, "component").agg(
        pixels().alias("area"), F.sum(F.when(both, _c("x1") - _c("x0")).otherwise(0)).alias("shared"))
    mask = per.groupBy(*MASK).agg(
        F.sum("area").alias("_union"), F.sum("shared").alias("_shared"),
        F.count_if(_c("component").isNotNull() & (_c("area") >= 3) & (_c("shared") == 0)).alias("_lost"))
    page = mask.groupBy("image_id").agg(F.max((_c("_union") - _c("_shared")) / F.greatest(F.lit(1), _c("_union"))).alias("max_changed"),
                                        F.sum("_lost").alias("lost_components"))
    return page.select("image_id", "max_changed", "lost_components",
                       ((_c("max_changed") <= gate) & (_c("lost_components") == 0)).alias("passed"))


def text_line_stats(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Band heights, gaps and densities of each mask, and whether it reads as text lines.

    ``boxes``: image_id, mask_id, w, h of the mask window.
    """
    ink = runs.groupBy(*LINE).agg(F.sum(_c("x1") - _c("x0")).alias("ink"))
    # a mask's lines cross the network as one row, at most one entry per line of the image
    lines = ink.groupBy(*MASK).agg(F.collect_list(F.struct("y", "ink")).alias("_lines"), F.sum("ink").alias("_ink")).join(boxes, MASK)
    lines = lines.select(*MASK, (_c("_ink") / (_c("w") * _c("h"))).alias("density"), (_c("w") * 0.02).alias("_share"), F.explode("_lines").alias("_l"))
    bands = merge_runs(lines.where(_c("_l.ink") >= F.greatest(F.lit(3.0), "_share")).select(
        *MASK, "density", _c("_l.y").alias("x0"), (_c("_l.y") + 1).alias("x1")), [*MASK, "density"])
    down = Window.partitionBy(*MASK).orderBy("x0")  # at most one band per two scan lines
    spaced = bands.withColumn("_h", _c("x1") - _c("x0")).withColumn("_gap", _c("x0") - F.lag("x1").over(down))
    stats = spaced.groupBy(*MASK).agg(
        F.first("density").alias("density"),
        F.count(F.lit(1)).alias("bands"), F.median("_h").alias("height"), F.min("_h").alias("_low"), F.max("_h").alias("_high"),
        F.min("_gap").alias("min_gap"), F.median("_gap").alias("gap"))
    h = _c("height")
    ok = (_c("bands").between(6, 80) & (h >= 3) & (_c("_low") >= h * 0.5) & (_c("_high") <= h * 1.6)
          & (_c("min_gap") >= F.greatest(F.lit(2.0), h * 0.25)) & (_c("gap") <= h * 2)
          & (_c("density") > 0.03) & (_c("density") < 0.65))
    return stats.select(*MASK, "bands", "height", "min_gap", "gap", "density",
                                          F.coalesce(ok, F.lit(False)).alias("accepted"))
