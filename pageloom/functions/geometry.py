"""Boxes and polygons as columns.  A polygon is array<struct<x:double,y:double>>.

Spark interprets nested array expressions row by row, so the tests that walk all
edges of a polygon work on whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYGON = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Pairs of edges that are compared at once.
PAIRS = 1 << 20


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_to_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def polygon_to_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return F.when(F.size(p) > 0, F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h")))


def following(p: Column) -> Column:
    """The same vertices, each replaced by its successor."""
    return F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def edges(p: Column) -> Column:
    return F.arrays_zip(p.alias("a"), following(p).alias("b"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def polygon_area(p: Column) -> Column:
    return F.abs(_total(F.zip_with(p, following(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2


def _rings(p: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, polygon, next) of every corner, and the corners of each polygon; a missing number is NaN."""
    at = p.offsets.to_numpy()
    corners = p.values.slice(at[0], at[-1] - at[0])
    x, y = (pc.struct_field(corners, k).to_numpy(zero_copy_only=False).astype(np.float64) for k in "xy")
    sizes = np.diff(at)
    after = np.arange(1, len(x) + 1)
    ends = (at[1:] - at[0])[sizes > 0]
    after[ends - 1] = ends - sizes[sizes > 0]
    return x, y, np.repeat(np.arange(len(sizes)), sizes), after, sizes


def _crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the polygons (rows) of one size have two edges that share no vertex and meet."""
    n = x.shape[1]
    i, j = np.triu_indices(n, 2)
    far = ~((i == 0) & (j == n - 1))
    i, j = i[far], j[far]
    found = np.zeros(len(x), bool)
    rows = max(1, PAIRS // max(1, len(i)))
    for at in range(0, len(x), rows):
        u, v = x[at:at + rows], y[at:at + rows]
        a, b, c, d = ((u[:, k % n], v[:, k % n]) for k in (i, i + 1, j, j + 1))
        turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        apart = np.zeros(a[0].shape, bool)
        for k in (0, 1):
            apart |= (np.maximum(np.minimum(a[k], b[k]), np.minimum(c[k], d[k])) > np.minimum(np.maximum(a[k], b[k]), np.maximum(c[k], d[k])))
        found[at:at + rows] = (~apart & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)).any(axis=1)
    return found


@F.arrow_udf(T.StringType())
def invalid_reason(p: pa.Array) -> pa.Array:
    """Null for a valid simple polygon, else why it is not one."""
    with np.errstate(all="ignore"):
        x, y, own, after, sizes = _rings(p)
        n = len(p)
        out = np.full(n, None, object)
        area = np.abs(np.bincount(own, x * y[after] - x[after] * y, n)) / 2
        order = np.lexsort((y, x, own))
        u, v, w = x[order], y[order], own[order]
        twice = np.bincount(w[1:], (u[1:] == u[:-1]) & (v[1:] == v[:-1]) & (w[1:] == w[:-1]), n) > 0
        lost = np.bincount(own, ~(np.isfinite(x) & np.isfinite(y)), n) > 0
        count = ~p.is_valid().to_numpy(zero_copy_only=False) | (sizes < 3) | (sizes > 2000)
        bad = count | lost | twice | (area < 1)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[~bad]):
            rows = np.nonzero(~bad & (sizes == size))[0]
            at = starts[rows, None] + np.arange(size)
            out[rows[_crossed(x[at], y[at])]] = "self_crossing"
        for reason, rows in (("degenerate", area < 1), ("repeated_vertex", twice), ("not_finite", lost), ("count", count)):
            out[rows] = reason
    return pa.array(out, pa.string())


def _inside(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the stretches where the line at height ``at`` runs inside each outline (even-odd); unused ones are empty."""
    met = (y > at) != (ny > at)
    xs = np.sort(np.where(met, x + (at - y) * (nx - x) / (ny - y), np.inf), axis=1)[:, :x.shape[1] // 2 * 2]
    return tuple(np.where(np.isinf(xs[:, k::2]), 0.0, xs[:, k::2]) for k in (0, 1))


def _shared(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """(both, first, second) of pairs of outlines, one pair a row, all of the same two sizes."""
    first, second = ((x, y, np.roll(x, -1, 1), np.roll(y, -1, 1)) for x, y in ((px, py), (qx, qy)))
    s, t = [v[:, :, None] for v in first], [v[:, None, :] for v in second]
    turn = lambda e, x, y: (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    u, v = turn(s, t[0], t[1]), turn(s, t[2], t[3])
    cross = (u * v < 0) & (turn(t, s[0], s[1]) * turn(t, s[2], s[3]) < 0)
    heights = np.where(cross, t[1] + (t[3] - t[1]) * u / (u - v), np.inf).reshape(len(px), -1)
    cuts = np.sort(np.concatenate([py, qy, heights], axis=1), axis=1)
    out = np.zeros((3, len(px)))
    for k in range(cuts.shape[1] - 1):
        rows = np.nonzero((cuts[:, k] < cuts[:, k + 1]) & (cuts[:, k + 1] < np.inf))[0]
        if not len(rows):
            continue
        low, high = cuts[rows, k], cuts[rows, k + 1]
        middle = ((low + high) / 2)[:, None]
        (al, ar), (bl, br) = (_inside(*[v[rows] for v in e], middle) for e in (first, second))
        common = np.minimum(ar[:, :, None], br[:, None, :]) - np.maximum(al[:, :, None], bl[:, None, :])
        wide = (np.maximum(common, 0).sum(axis=(1, 2)), (ar - al).sum(axis=1), (br - bl).sum(axis=1))
        out[:, rows] += np.stack(wide) * (high - low)
    return out


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("both", "first", "second")]))
def shared_areas(p: pa.Array, q: pa.Array) -> pa.Array:
    """(both, first, second): exact areas of two simple outlines, dented ones too, and of what they share.

    The plane is cut at every height where an outline has a corner or the two
    cross.  Between two cuts no edges cross, so both outlines are trapezoids,
    whose areas, and those of their overlaps, are height times width half way.
    Null if an outline or one of its numbers is missing.
    """
    with np.errstate(all="ignore"):
        rings = [_rings(c) for c in (p, q)]
        lost = np.zeros(len(p), bool)
        for c, (x, y, own, _, _) in zip((p, q), rings):
            lost |= ~c.is_valid().to_numpy(zero_copy_only=False) | (np.bincount(own, ~(np.isfinite(x) & np.isfinite(y)), len(p)) > 0)
        sizes = np.stack([r[4] for r in rings], axis=1)
        starts = np.cumsum(sizes, axis=0) - sizes
        out = np.zeros((3, len(p)))
        for m, n in np.unique(sizes[~lost], axis=0):
            rows = np.nonzero(~lost & (sizes == (m, n)).all(axis=1))[0]
            step = max(1, PAIRS // max(1, m * n))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                corners = [r[k][starts[part, i, None] + np.arange(size)] for i, (r, size) in enumerate(zip(rings, (m, n))) for k in (0, 1)]
                out[:, part] = _shared(*corners)
    return pa.StructArray.from_arrays([pa.array(v) for v in out], ["both", "first", "second"], mask=pa.array(lost))


def rotate_polygon(p: Column, cx: Column, cy: Column, degrees: Column,
                   width: Column | None = None, height: Column | None = None) -> Column:
    """Rotate about (cx, cy); clip to the page when its size is given."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def move(v: Column) -> Column:
        x = cx + (v["x"] - cx) * c - (v["y"] - cy) * s
        y = cy + (v["x"] - cx) * s + (v["y"] - cy) * c
        if width is not None:
            x, y = F.least(F.greatest(x, F.lit(0.0)), width), F.least(F.greatest(y, F.lit(0.0)), height)
        return point(x, y)
    return F.transform(p, move)


def aligned_frame(p: Column, degrees: Column) -> Column:
    """Box of a rectangle drawn at ``degrees``; null unless it is one."""
    centre = let(p, lambda q: F.struct(
        q.alias("q"), (_total(F.transform(q, lambda v: v["x"])) / F.size(q)).alias("x"),
        (_total(F.transform(q, lambda v: v["y"])) / F.size(q)).alias("y")))

    def from_centre(c: Column) -> Column:
        flat = rotate_polygon(c["q"], c["x"], c["y"], -degrees)
        return let(F.struct(c.alias("c"), flat.alias("flat")), lambda s: let(
            F.struct(s["c"].alias("c"), s["flat"].alias("flat"), polygon_to_box(s["flat"]).alias("box")), judge))

    def judge(s: Column) -> Column:
        box, flat = s["box"], s["flat"]
        gap = lambda v, k, side: (F.abs(v[k] - box[k]), F.abs(v[k] - box[k] - box[side]))
        slack = F.greatest(box["w"], box["h"]) * 1e-6
        on_corner = F.forall(flat, lambda v: (F.least(*gap(v, "x", "w")) <= slack) & (F.least(*gap(v, "y", "h")) <= slack))
        corners = F.array_distinct(F.transform(flat, lambda v: F.struct(
            (gap(v, "x", "w")[1] < gap(v, "x", "w")[0]).alias("r"), (gap(v, "y", "h")[1] < gap(v, "y", "h")[0]).alias("b"))))
        ok = ((F.size(flat) == 4) & (F.abs(degrees) > 0.01) & (F.least(box["w"], box["h"]) >= 2)
              & on_corner & (F.size(corners) == 4))
        return F.when(ok, F.struct(
            F.round(s["c"]["x"] - box["w"] / 2, 6).alias("x"), F.round(s["c"]["y"] - box["h"] / 2, 6).alias("y"),
            F.round(box["w"], 6).alias("w"), F.round(box["h"], 6).alias("h")))
    return let(centre, from_centre)


def point_in_polygon(p: Column, x: Column, y: Column, slack: float = 1e-6) -> Column:
    """Even-odd test; points on an edge count as inside.  Null if the polygon, one of its numbers or the point is missing."""
    @F.arrow_udf(T.BooleanType())
    def inside(p: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            ax, ay, own, after, _ = _rings(p)
            bx, by = ax[after], ay[after]
            u, v = (c.to_numpy(zero_copy_only=False).astype(np.float64)[own] for c in (x, y))
            dx, dy = bx - ax, by - ay
            length2 = dx * dx + dy * dy
            t = np.clip(np.where(length2 == 0, 0.0, ((u - ax) * dx + (v - ay) * dy) / length2), 0, 1)
            gx, gy = u - (ax + t * dx), v - (ay + t * dy)
            on_edge = gx * gx + gy * gy <= slack * slack
            ray_hits = ((ay > v) != (by > v)) & (u < dx * (v - ay) / dy + ax)
            n = len(p)
            found = (np.bincount(own, on_edge, n) > 0) | (np.bincount(own, ray_hits, n) % 2 == 1)
            lost = np.bincount(own, np.isnan(ax) | np.isnan(ay), n) > 0
        lost |= ~np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (p, x, y)])
        return pa.array(found, mask=lost)
    return inside(p, x.cast("double"), y.cast("double"))


@F.arrow_udf(POLYGON)
def order_quad(p: pa.Array) -> pa.Array:
    """Corners from the top-left one clockwise; null when not a usable convex quad."""
    with np.errstate(all="ignore"):
        x, y, _, _, sizes = _rings(p)
        rows = np.nonzero(p.is_valid().to_numpy(zero_copy_only=False) & (sizes == 4))[0]
        at = (np.cumsum(sizes) - sizes)[rows, None] + np.arange(4)
        x, y = x[at], y[at]
        i, j = np.triu_indices(4, 1)
        ok = ~((x[:, i] == x[:, j]) & (y[:, i] == y[:, j])).any(axis=1)
        total = lambda v: v[:, 0] + v[:, 1] + v[:, 2] + v[:, 3]
        angle = np.arctan2(y - total(y)[:, None] / 4, x - total(x)[:, None] / 4)
        around = np.lexsort((y, x, angle), axis=1)
        x, y = np.take_along_axis(x, around, 1), np.take_along_axis(y, around, 1)
        first = np.lexsort((x, y, x + y), axis=1)[:, :1]
        turned = (np.arange(4) + first) % 4
        x, y = np.take_along_axis(x, turned, 1), np.take_along_axis(y, turned, 1)
        nx, ny, fx, fy = np.roll(x, -1, 1), np.roll(y, -1, 1), np.roll(x, -2, 1), np.roll(y, -2, 1)
        turn = (nx - x) * (fy - y) - (ny - y) * (fx - x)
        side = np.hypot(nx - x, ny - y)
        area = np.abs(total(x * ny - nx * y)) / 2
        ok &= ((turn.min(1, initial=np.inf) > 1e-6) & (side.min(1, initial=np.inf) >= 2) & (area >= 4)
               & (area >= 0.01 * np.ptp(x, 1) * np.ptp(y, 1)) & ((turn / (side * np.roll(side, -1, 1))).min(1, initial=np.inf) >= 1e-3))
    none = np.ones(len(p), bool)
    none[rows[ok]] = False
    at = np.concatenate([[0], np.cumsum(~none) * 4]).astype(np.int32)
    corners = pa.StructArray.from_arrays([pa.array(x[ok].ravel()), pa.array(y[ok].ravel())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(at), corners, mask=pa.array(none))


def split_box(x: Column, y: Column, w: Column, h: Column, axis: Column) -> Column:
    """array of two struct<x,y,w,h>: halves side by side (vertical cut) or stacked."""
    def part(px: Column, py: Column, pw: Column, ph: Column) -> Column:
        return F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"),
                        pw.cast("double").alias("w"), ph.cast("double").alias("h"))
    upright = F.array(part(x, y, w / 2, h), part(x + w / 2, y, w / 2, h))
    stacked = F.array(part(x, y, w, h / 2), part(x, y + h / 2, w, h / 2))
    cut = F.when(axis == "auto", F.when(w >= h, "vertical").otherwise("horizontal")).otherwise(axis)
    return F.when(cut == "vertical", upright).otherwise(stacked)


def linear_luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 0-255 sRGB channels."""
    def linear(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return linear(r) * 0.2126 + linear(g) * 0.7152 + linear(b) * 0.0722
