"""Text angle of a point cloud by projection profiles.

Every point votes in a soft histogram across the lines for each candidate
angle and writing direction; a sharp profile has a large sum of squares.
Repeated points count as weights, so a mask is one row of at most the points
of its image, and the masks of a batch are scored together: one sort of the
bins that hold votes, whatever the size of the image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.components import _numbers, _owners

_c = F.col
# Candidate angles in degrees and the thresholds of acceptance.
COARSE, LIMIT, FINE_REACH, FINE_STEP = 3.0, 45.0, 3.0, 0.5
MIN_POINTS, MIN_TURN, MIN_GAIN, RIVAL, RIVAL_APART, UNSURE = 24, 3.0, 1.10, 0.98, 5.0, 0.05
SECTIONS, SECTION_POINTS, SECTION_LOSS, SECTION_WEIGHT, SECTION_GAIN, SECTION_NEAR = 3, 12, 0.90, 0.2, 1.03, 0.97
#: Votes that are sorted at once.
VOTES = 1 << 17
_GRID = np.arange(-LIMIT, LIMIT + COARSE, COARSE)
_AROUND = np.arange(-FINE_REACH, FINE_REACH + FINE_STEP, FINE_STEP)
_FOUND = "struct<points:bigint,vertical:boolean,sure_direction:boolean,candidate:double,score:double,angle:double>"


class _Cloud:
    """Points of some masks: their mask, place and number."""

    def __init__(self, mask: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.mask, self.x, self.y, self.n = mask, x, y, n

    def of(self, keep: np.ndarray) -> _Cloud:
        return _Cloud(self.mask[keep], self.x[keep], self.y[keep], self.n[keep])

    def across(self, vertical: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """(point, angle): place across lines of each direction and angle of the point's mask."""
        cos, sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        upright = vertical[:, None]
        return self.x[:, None] * np.where(upright, cos, -sin)[self.mask] + self.y[:, None] * np.where(upright, sin, cos)[self.mask]

    def scores(self, vertical: np.ndarray, angle: np.ndarray, total: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """(group, angle): sum of squared soft-histogram bins for each of the group's ``total`` points.

        ``vertical`` and ``angle`` have a row for each mask; a group is a mask unless ``group`` says otherwise.
        """
        group, many = self.mask if group is None else group, angle.shape[1]
        out, repeated = np.zeros((len(total), many)), (self.n != 1).any()
        step = max(1, VOTES // max(1, len(group)))
        for a in range(0, many if len(group) else 0, step):
            t = self.across(vertical, angle[:, a:a + step])
            width = t.shape[1]
            low = np.floor(t)
            share, low = (t - low).ravel(), low.astype(np.int64)
            low -= low.min()
            span = int(low.max()) + 2
            key = (((group * width)[:, None] + np.arange(width)) * span + low).ravel()
            key, order = _sorted(key, len(total) * width * span)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            share = share[order]
            if repeated:
                n = self.n[order // width]
                up, held = np.add.reduceat(share * n, first), np.add.reduceat(n, first)
            else:
                up, held = np.add.reduceat(share, first), np.diff(first, append=len(key))
            down, bins = held - up, key[first]
            squares = down * down + up * up
            squares[1:] += np.where(bins[1:] == bins[:-1] + 1, 2 * down[1:] * up[:-1], 0)
            out[:, a:a + width] = np.bincount(bins // span, squares, len(total) * width).reshape(len(total), width)
        return np.round(out / np.maximum(total, 1)[:, None], 9)


def _sorted(key: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys below ``end`` and where they were; both are sorted as one number where that fits."""
    bits = len(key).bit_length()
    if end.bit_length() + bits > 62:
        order = np.argsort(key)
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & (1 << bits) - 1


def _best(scores: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Column of the highest score of each row, ties to the smaller turn, then to the smaller angle."""
    turn = np.abs(angles) * 4 + (angles > 0)
    return np.where(scores == scores.max(axis=1, keepdims=True), turn, np.inf).argmin(axis=1)


def _candidates(cloud: _Cloud, vertical: bool, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and angles of one direction: the coarse ones, and finer ones around the three best."""
    n = len(total)
    way, coarse = np.full(n, vertical), np.broadcast_to(_GRID, (n, len(_GRID)))
    scores = cloud.scores(way, coarse, total)
    # equal scores: the larger angle first
    peaks = _GRID[::-1][np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :3]]
    fine = (peaks[:, :, None] + _AROUND[_AROUND % COARSE != 0]).reshape(n, -1)
    finer = np.where(np.abs(fine) <= LIMIT, cloud.scores(way, fine, total), -np.inf)
    return np.hstack([scores, finer]), np.hstack([coarse, fine])


def _supported(cloud: _Cloud, vertical: np.ndarray, angle: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Do at least two of three sections along the lines favour the angle by themselves?"""
    n = len(total)
    along = cloud.across(~vertical, angle[:, None])[:, 0]
    start, end = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(start, cloud.mask, along)
    np.maximum.at(end, cloud.mask, along)
    long = end + 1 - start
    place = np.minimum(np.floor((along - start[cloud.mask]) * SECTIONS / long[cloud.mask]), SECTIONS - 1).astype(np.int64)
    group = cloud.mask * SECTIONS + place
    size = np.bincount(group, cloud.n, n * SECTIONS)
    asked = np.hstack([angle[:, None], np.zeros((n, 1)), angle[:, None] - 1, angle[:, None] + 1, np.broadcast_to(_GRID, (n, len(_GRID)))])
    scores = cloud.scores(vertical, asked, size, group)
    nearest = np.repeat(asked, SECTIONS, axis=0)[np.arange(n * SECTIONS), _best(scores, np.repeat(asked, SECTIONS, axis=0))]
    own, level, mine = scores[:, 0], scores[:, 1], np.repeat(angle, SECTIONS)
    enough = size >= SECTION_POINTS
    gain = np.divide(own, level, out=np.zeros_like(own), where=level > 0)
    close = (np.abs(nearest - mine) <= COARSE) | (own >= SECTION_NEAR * scores.max(axis=1))
    against = enough & (gain < SECTION_LOSS) & (size >= SECTION_WEIGHT * np.repeat(total, SECTIONS))
    favour = enough & (gain >= SECTION_GAIN) & close
    return ~against.reshape(n, SECTIONS).any(axis=1) & (favour.reshape(n, SECTIONS).sum(axis=1) >= 2)


def _angles(clouds: pa.Array) -> pa.Array:
    mask, points = _owners(clouds)
    x, y, n = _numbers(points, "px", "py", "n")
    n = n.astype(float)
    total = np.bincount(mask, n, len(clouds))
    cloud = _Cloud(mask, x, y, n).of(np.isfinite(x) & np.isfinite(y))
    known = np.bincount(cloud.mask, minlength=len(clouds)) > 0
    (across, turns), (down, falls) = (_candidates(cloud, way, total) for way in (False, True))
    row = np.arange(len(clouds))
    h, v = _best(across, turns), _best(down, falls)
    upright = down[row, v] > across[row, h]
    sure = np.abs(down[row, v] - across[row, h]) > UNSURE * np.maximum(down[row, v], across[row, h])
    scores, angles = np.where(upright[:, None], down, across), np.where(upright[:, None], falls, turns)
    at = np.where(upright, v, h)
    score, angle = scores[row, at], angles[row, at]
    rival = ((scores >= RIVAL * score[:, None]) & (np.abs(angles - angle[:, None]) >= RIVAL_APART)).any(axis=1)
    level = scores[:, np.flatnonzero(_GRID == 0)[0]]
    good = (np.abs(angle) >= MIN_TURN) & (total >= MIN_POINTS) & (score >= MIN_GAIN * level) & ~rival & (sure | (np.abs(angle) < LIMIT - 2))
    # sections are asked only where nothing else is against the angle
    left = np.flatnonzero(good & known)
    if len(left):
        some = cloud.of(np.isin(cloud.mask, left))
        some.mask = np.searchsorted(left, some.mask)
        good[left] = _supported(some, upright[left], angle[left], total[left])
    columns = {"points": total.astype(np.int64), "vertical": upright, "sure_direction": sure, "candidate": angle, "score": score,
               "angle": np.where(good, angle, 0.0)}
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns), mask=pa.array(~known))


def angle_search(points: DataFrame, key: str) -> DataFrame:
    """Best text angle per mask, 0 unless it is clear and independent sections agree.

    ``points``: key, px, py; masks of fewer than four points have no row.  Points without a (finite) place count, but do not vote.
    """
    @F.arrow_udf(_FOUND)
    def search(clouds: pa.Array) -> pa.Array:
        few = VOTES // len(_GRID)
        sizes = np.cumsum(pc.list_value_length(clouds).to_numpy())
        cuts = np.r_[0, np.flatnonzero(np.diff(sizes // few)) + 1, len(clouds)]
        return pa.concat_arrays([_angles(clouds.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    placed = points.select(key, _c("px").cast("double").alias("px"), _c("py").cast("double").alias("py"))
    single = placed.groupBy(key, "px", "py").agg(F.count(F.lit(1)).alias("n"))
    clouds = single.groupBy(key).agg(F.collect_list(F.struct("px", "py", "n")).alias("_points"), F.sum("n").alias("_n")).where("_n >= 4")
    found = clouds.select(key, search("_points").alias("_f")).where("_f is not null")
    return found.select(key, "_f.points", "_f.vertical", "_f.sure_direction", "_f.candidate", F.round("_f.score", 6).alias("score"), "_f.angle")
