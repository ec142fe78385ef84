"""Greedy and component operators against slow plain-Python versions."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pageloom.core import ranking
from pageloom.functions import text as X
from pageloom.functions import scoring
from pageloom.functions.regions import unique_key
from pageloom.functions.replies import read_reply
from pageloom.operators import components as C
from pageloom.operators import lineage
from pageloom.operators import ordering as O
from pageloom.operators import workflow as K
from pageloom.operators.angles import angle_search


def boxes(seed, pages=4, n=14):
    rng = random.Random(seed)
    return [(p, i, i, rng.randrange(0, 60) * 10, rng.randrange(0, 90) * 10, rng.randrange(4, 20) * 10, rng.randrange(4, 30) * 10)
            for p in range(pages) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "image_id bigint, region_id bigint, seq bigint, x bigint, y bigint, w bigint, h bigint")


def slow_reading_order(rows):
    columns = []
    for r in sorted(rows, key=lambda r: (-(r[3] + r[5] / 2), r[2])):
        cx = r[3] + r[5] / 2
        fits = [(abs(cx - sum(m[3] + m[5] / 2 for m in c) / len(c)), k) for k, c in enumerate(columns)
                if abs(cx - sum(m[3] + m[5] / 2 for m in c) / len(c)) <= 0.45 * max([r[5]] + [m[5] for m in c])]
        if fits:
            columns[min(fits)[1]].append(r)
        else:
            columns.append([r])
    columns.sort(key=lambda c: -sum(m[3] + m[5] / 2 for m in c) / len(c))
    return [r[1] for c in columns for r in sorted(c, key=lambda m: (m[4], -(m[3] + m[5] / 2)))]


def test_reading_order(spark):
    rows = boxes(1)
    got = O.reading_order(frame(spark, rows).repartition(5)).collect()
    for page in range(4):
        order = [r.region_id for r in sorted((r for r in got if r.image_id == page), key=lambda r: r.position)]
        assert order == slow_reading_order([r for r in rows if r[0] == page])


def test_panel_order_reads_rows_then_right_to_left(spark):
    panels = frame(spark, [(1, 100, 0, 0, 0, 490, 500), (1, 101, 1, 510, 0, 490, 500), (1, 102, 2, 0, 520, 1000, 500)])
    texts = frame(spark, [(1, 1, 1, 100, 100, 50, 90), (1, 2, 2, 600, 100, 50, 90), (1, 3, 3, 400, 700, 50, 90)])
    got = {r.region_id: r.position for r in O.panel_reading_order(texts, panels).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == [2, 1, 3]


def test_components_match_flood_fill(spark):
    rng = random.Random(3)
    pixels = {(m, y, x) for m in range(3) for y in range(12) for x in range(12) if rng.random() < 0.4}
    runs = spark.createDataFrame([(1, m, y, x, x + 1) for m, y, x in pixels], "image_id bigint, mask_id bigint, y bigint, x0 bigint, x1 bigint")
    label = {}
    for r in C.components(runs).collect():
        for x in range(r.x0, r.x1):
            label[r.mask_id, r.y, x] = r.component
    assert set(label) == pixels
    seen, count = set(), 0
    for start in sorted(pixels):
        if start in seen:
            continue
        count += 1
        stack, names = [start], set()
        while stack:
            m, y, x = p = stack.pop()
            if p in seen:
                continue
            seen.add(p)
            names.add(label[p])
            stack += [(m, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (m, y + a, x + b) in pixels]
        assert len(names) == 1
    assert count == len({(k[0], v) for k, v in label.items()})


def test_pack_requests(spark):
    rng = random.Random(5)
    sizes = {p: [rng.randrange(1, 900) for _ in range(90)] for p in range(3)}
    df = spark.createDataFrame([(p, i, "x" * n) for p, s in sizes.items() for i, n in enumerate(s)], "image_id bigint, seq bigint, text string")
    got = {(r.image_id, r.seq): r.batch for r in O.pack_requests(df.repartition(7)).collect()}
    for p, s in sizes.items():
        batch, items, chars = 0, 0, 0
        for i, n in enumerate(s):
            if items and (items >= 32 or chars + n > 8000):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + n
            assert got[p, i] == batch


def test_ranked_and_previous_do_not_need_whole_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2]), v) for v in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(6)
    got = ranking.ranked(df, ["k"], [F.col("v")], F.floor(F.col("v") / 100)).collect()
    prev = {(r.k, r.v): r.prev_v for r in ranking.previous_row(df, ["k"], ["v"], F.floor(F.col("v") / 100), ["v"]).collect()}
    for k in (1, 2):
        order = sorted(v for a, v in rows if a == k)
        assert [r.v for r in sorted((r for r in got if r.k == k), key=lambda r: r.position)] == order
        assert [prev[k, v] for v in order] == [None] + order[:-1]


def test_value_ranks_quantiles(spark):
    rng = random.Random(9)
    values = [rng.randrange(0, 400) / 4 for _ in range(301)]
    df = spark.createDataFrame([(1, v) for v in values], "k bigint, v double")
    row = ranking.value_ranks(df, ["k"], "v", F.floor(F.col("v") / 8)).groupBy("k").agg(
        ranking.quantile("v", 0.95).alias("q"), ranking.value_at("v", F.col("total") - 1).alias("top")).first()
    s = sorted(values)
    at = 300 * 0.95
    want = s[int(at)] + (s[int(at) + 1] - s[int(at)]) * (at - int(at))
    assert abs(row.q - want) < 1e-9 and row.top == s[-1]


def test_focus_windows_cover_or_stop(spark):
    rows = [(p, *map(float, r[3:]), 1000, 1400) for r in boxes(11) for p in [r[0]]]
    df = spark.createDataFrame(rows, "image_id bigint, x double, y double, w double, h double, width bigint, height bigint")
    got = K.focus_windows(df).collect()
    for p in range(4):
        mine = [r for r in got if r.image_id == p]
        assert 1 <= len(mine) <= 6
        assert all(0 <= r.x <= 1000 - r.w and 0 <= r.y <= 1400 - r.h for r in mine)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Hello, wide world 3.14",), ("ああああああああああああ",), ("ab" * 8,), ("",)], "t string")
    rows = df.select("t", X.word_count(F.col("t")).alias("w"), X.wrap(F.col("t"), 6).alias("lines"), X.has_repetition(F.col("t")).alias("rep")).collect()
    assert rows[0].w == 5 and [r.rep for r in rows] == [False, True, True, False]
    assert all(len(line) <= 6 for line in rows[0].lines) and rows[3].lines == [""]
    text = "a" * 30 + " " + "b" * 30
    chunks = spark.createDataFrame([(text,)], "t string").select(X.text_chunks(F.col("t"), 40).alias("c")).first().c
    assert "".join(chunks) == text and chunks[0] == "a" * 30 + " "


def greedy_lines(text, width):
    """Wrap by trying every break place of ``can_break``, one cell at a time."""
    def may_end(a, b):
        word = regex.compile(r"['_\u2019A-Za-z0-9]|(?=[\u00C0-\u2E7F])[\p{L}\p{N}]")
        if a in list(X.OPENING) or b in list(X.CLOSING) or "\u00a0" in (a, b) or a == b and a in ("…", "—"):
            return False
        return not (word.match(a) and word.match(b) or a in (".", ",", ":") and regex.fullmatch("[0-9]+", b))

    cells, lines = regex.findall(r"\X", text or ""), []
    while len(cells) > width:
        places = [k for k in range(1, width + 1) if may_end(cells[k - 1], cells[k])]
        k = max(places, default=width)
        lines.append("".join(cells[:k]).rstrip(" "))
        cells = cells[k:]
        while cells and cells[0] == " ":
            cells.pop(0)
        if not cells:
            return lines
    return lines + ["".join(cells)]


def test_wrap_against_plain_code(spark):
    rng = random.Random(8)
    texts = ["", None, "  ", "日本語「テスト」。" * 9, "3.14159, 2,718 x" * 4, "…… —— (" * 6] + [
        "".join(rng.choices("ab 　(。」…1.,é\u0301\n", k=rng.randint(1, 70))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for width in (1, 6, 24):
        got = dict(df.select("i", X.wrap(F.col("t"), width)).collect())
        assert all(list(got[i]) == greedy_lines(t, width) for i, t in enumerate(texts))


def test_thin_bands(spark):
    """Restart from the first thin band until none is left."""
    def settle(bands, limit):
        bands = list(bands)
        while len(bands) > 1 and (thin := [i for i, (a, b) in enumerate(bands) if b - a < limit]):
            i = thin[0]
            gaps = {i - 1: bands[i][0] - bands[i - 1][1] if i else None, i: bands[i + 1][0] - bands[i][1] if i + 1 < len(bands) else None}
            low = min((k for k in gaps if gaps[k] is not None), key=lambda k: (gaps[k], k))
            bands[low:low + 2] = [(bands[low][0], bands[low + 1][1])]
        return bands

    rng, rows, want = random.Random(4), [], []
    for mask in range(200):
        at, bands = 0, []
        for _ in range(rng.randint(1, 9)):
            start = at + rng.randint(1, 8)
            at = start + rng.randint(1, 12)
            bands.append((start, at))
        rows += [(mask, *b) for b in bands]
        want += [(mask, *b) for b in settle(bands, 7.2)]
    heights = spark.range(200).selectExpr("id as mask_id", "16.0D as height")
    assert sorted(map(tuple, O.merge_tiny_bands(spark.createDataFrame(rows, "mask_id long, x0 long, x1 long"), heights).collect())) == sorted(want)


def test_text_angle_of_slanted_lines(spark):
    rng, rows = random.Random(2), []
    for k, degrees in enumerate((0, 12, -20, 30)):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        for line in range(5):
            for _ in range(60):
                u, v = rng.uniform(0, 150), line * 14 + rng.uniform(0, 4)
                rows.append((k, u * c - v * s, u * s + v * c))
    got = {r.k: r for r in angle_search(spark.createDataFrame(rows, "k long, px double, py double"), "k").collect()}
    assert [got[k].vertical for k in range(4)] == [False] * 4 and got[0].angle == 0 and got[0].points == 300
    assert all(abs(got[k].angle - d) <= 1 for k, d in ((1, 12), (2, -20), (3, 30)))


def test_names_sort_as_people_do(spark):
    names = ["page-1", "page1", "Page 2", "page10", "page9", "p" + "9" * 21, "p1" + "0" * 21, "10", "9", "a", "007", "7b"]

    def key(name):
        return [(1, int(x)) if x.isdecimal() else (0, x) for x in regex.split(r"(\d+)", name.lower()) if x or True]

    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n").collect()]
    assert got == sorted(names, key=lambda n: (key(n), n))


def test_moves_keep_every_page_once(spark):
    pages = spark.createDataFrame([(p, i, i) for p in (1, 2) for i in range(6)], "project_id long, image_id long, order_index long")
    moves = spark.createDataFrame([(1, 0, 3), (1, 5, 1), (2, 0, 2), (2, 4, 2)], "project_id long, image_id long, target_index long")
    got = {(r.project_id, r.image_id): r.new_index for r in O.move_page(pages, moves).collect()}
    assert [got[1, i] for i in range(6)] == [3, 5, 2, 0, 4, 1] and [got[2, i] for i in range(6)] == list(range(6))


def test_protected_folders_keep_what_lies_below(spark):
    files = spark.createDataFrame([(1, f"{d}/f", 99) for d in ("keep", "keep/a", "keep/a/b", "keeper", "x", "x/keep")],
                                  "project_id long, path string, age_minutes long")
    kept = spark.createDataFrame([("keep",)], "directory string")
    gone = lineage.orphan_assets(files, files.where("false"), 10, kept)
    assert sorted(r.path for r in gone.collect()) == ["keeper/f", "x/f", "x/keep/f"]


def test_cached_scores_lose_no_row(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, "a", "b"), (4, "c", "d")], "i long, p string, q string")
    keyed = {r.i: r.cache_key for r in scoring.cache_key(rows, "c", ["p", "q"]).collect()}
    assert len(set(keyed.values())) == 4
    cache = spark.createDataFrame([(keyed[1], 10), (keyed[3], 1), (keyed[3], 2), (keyed[4], None)], "cache_key string, score long")
    hits, fresh, corrupt = scoring.cached_score(rows, cache, "c", ["p", "q"], lambda d: d.withColumn("score", F.lit(0)), "score")
    assert [r.i for r in hits.collect()] == [1] and sorted(r.i for r in fresh.collect()) == [2, 3, 4] and corrupt.count() == 2


def test_replies():
    assert read_reply('```json\n{"[r1]": "a"}\n```') == ({"r1": "a"}, None)
    assert read_reply('{"translations": {"r1": "a", "r2": "b') == ({"r1": "a"}, None)
    assert read_reply('{"r1": "a", "r1": "b"}') == (None, "duplicate_ids")
    assert read_reply('{"r1": 3}') == (None, "non_string_value")
    assert read_reply("oops") == (None, "invalid_json")


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, 1, "R1"), (1, 2, "R1-2"), (1, 3, "R1"), (1, 4, "R1"), (2, 1, "R1")], "image_id bigint, seq bigint, region_key string")
    got = {(r.image_id, r.seq): r.unique_key for r in unique_key(df).collect()}
    assert got == {(1, 1): "R1", (1, 2): "R1-2", (1, 3): "R1-3", (1, 4): "R1-4", (2, 1): "R1"}


def test_frames_of_any_outline_share_exact_areas(spark):
    """Turned, dented and star-like outlines against a fine raster, and cases known by hand."""

    from pageloom.functions import geometry as G
    rng = random.Random(8)

    def star(cx, cy, corners, dented):
        turn = rng.random()
        return [(cx + r * math.cos(a), cy + r * math.sin(a)) for k in range(corners)
                for a, r in [((k + turn) * 2 * math.pi / corners, 30 * (rng.uniform(0.3, 1) if dented else 1))]]

    def inside(ring, x, y):
        hits = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            hits += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return hits % 2
    square, dent = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (5, 5), (10, 10), (0, 10)]
    known = [(square, [(5, 5), (15, 5), (15, 15), (5, 15)], 25.0), (square, square[::-1], 100.0), (square, dent, 75.0), (dent, dent, 75.0),
             (dent, [(6, 4), (9, 4), (9, 6), (6, 6)], 0.0), (square, [(10, 0), (20, 0), (20, 10), (10, 10)], 0.0),
             (square, [(5, -5), (15, 5), (5, 15), (-5, 5)], 100.0)]
    drawn = [(star(0, 0, rng.randint(3, 7), i % 2), star(rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randint(3, 6), i % 3)) for i in range(12)]
    ring = "array<struct<x:double,y:double>>"
    rows = [([(float(x), float(y)) for x, y in p], [(float(x), float(y)) for x, y in q], i) for i, (p, q) in enumerate([k[:2] for k in known] + drawn)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, f"p {ring}, q {ring}, i int").select("i", G.shared_areas(F.col("p"), F.col("q")).alias("s")).collect()}
    for i, (p, q, want) in enumerate(known):
        assert got[i].both == pytest.approx(want, abs=1e-9)
    step = 0.5
    for i, (p, q) in enumerate(drawn, len(known)):
        grid = [(x * step + 0.25, y * step + 0.25) for x in range(-140, 140) for y in range(-140, 140)]
        in_p = [k for k in grid if inside(p, *k)]
        both = sum(inside(q, *k) for k in in_p) * step * step
        assert got[i].first == pytest.approx(len(in_p) * step * step, abs=40) and got[i].both == pytest.approx(both, abs=40)


def test_cells_are_read_by_their_cuts():
    """Across the page first, then from the right; boxes that no gutter of 2 parts stay together."""
    import numpy as np
    grid = [(0, 0, 40, 40), (50, 0, 40, 40), (0, 50, 90, 40)]
    assert O._cells(np.array(grid, float)) == [[1], [0], [2]]
    assert O._cells(np.array([(0, 0, 40, 40), (41, 0, 40, 41), (0, 41, 40, 40), (90, 60, 9, 20)], float)) == [[3], [0, 2, 1]]
    rng = random.Random(5)
    for _ in range(200):
        boxes = np.array([[rng.randrange(0, 90, 3), rng.randrange(0, 90, 3), rng.randint(1, 30), rng.randint(1, 30)] for _ in range(9)], float)
        cells = O._cells(boxes)
        assert sorted(i for c in cells for i in c) == list(range(9))
        for c in cells:
            for axis in (0, 1):
                marks = sorted((boxes[i][axis], boxes[i][axis] + boxes[i][axis + 2]) for i in c)
                assert all(b - max(e for _, e in marks[:k]) < 2 for k, (b, _) in enumerate(marks) if k)


def test_shared_areas_of_odd_outlines(spark):
    """Missing corners and numbers give null, pairs of different sizes are measured in one batch."""
    from pageloom.functions import geometry as G
    square, none = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], float("nan")
    dented = [(0.0, 0.0), (4.0, 0.0), (2.0, 2.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(square, dented, 0), (dented, dented, 1), (square, None, 2), (square, [(0.0, none), (1.0, 0.0), (1.0, 1.0)], 3), (square, [], 4)]
    ring = "array<struct<x:double,y:double>>"
    made = spark.createDataFrame(rows, f"p {ring}, q {ring}, i int").coalesce(1)
    got = {r.i: r.s and tuple(r.s) for r in made.select("i", G.shared_areas(F.col("p"), F.col("q")).alias("s")).collect()}
    assert got == {0: (12.0, 16.0, 12.0), 1: (12.0, 12.0, 12.0), 2: None, 3: None, 4: (0.0, 16.0, 0.0)}


def test_boxes_among_themselves_on_few_and_full_pages(spark):
    from pageloom.core import grid
    draw = random.Random(7)
    sizes = {1: 1, 2: 5, 3: grid.FEW, 4: grid.FEW + 1, 5: 150}
    rows = [(page, i, draw.randrange(900), draw.randrange(900), draw.randrange(300), draw.randrange(300)) for page, n in sizes.items() for i in range(n)]
    boxes = spark.createDataFrame(rows, "image_id long, region_id long, x long, y long, w long, h long")
    met = grid.among(boxes, lambda a, b: a["region_id"] < b["region_id"])
    got = sorted((r.image_id, r.a_region_id, r.b_region_id, r.inter) for r in met.collect())
    wide = lambda p, q, r, s: min(p + r, q + s) - max(p, q)
    assert got == sorted((a[0], a[1], b[1], wide(a[2], b[2], a[4], b[4]) * wide(a[3], b[3], a[5], b[5])) for a in rows for b in rows
                         if a[0] == b[0] and a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    assert "explode" in met._jdf.queryExecution().toString() and got


def test_layout_tree_of_few_and_full_pages(spark, monkeypatch):
    """Pages packed to a row and pages in cells give one tree, from few shuffles."""
    from pageloom.core import grid
    from pageloom.operators.layout import layout_tree
    draw = random.Random(11)
    rows = [(p, i, draw.randrange(600), draw.randrange(600), draw.randrange(20, 60 if i % 3 else 400), draw.randrange(20, 60 if i % 3 else 400),
             ("text", "bubble", "panel", "text", "onomatopoeia")[draw.randrange(5)], 0.5) for p in range(3) for i in range(40)]
    made = spark.createDataFrame(rows, "image_id long, region_id long, x long, y long, w long, h long, label string, confidence double")

    def tree():
        found = layout_tree(made)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 8
        return sorted(tuple(r) for r in found.collect())
    packed = tree()
    monkeypatch.setattr(grid, "FEW", 1)
    assert packed == tree() and any(r[3] is not None for r in packed)
    for page in range(3):
        assert sorted(r[5] for r in packed if r[0] == page) == list(range(1, 41))


def slow_sharpness(points, vertical, angle):
    bins, turn = {}, math.radians(angle)
    for x, y in points:
        t = x * math.cos(turn) + y * math.sin(turn) if vertical else y * math.cos(turn) - x * math.sin(turn)
        low = math.floor(t)
        bins[low] = bins.get(low, 0) + 1 - (t - low)
        bins[low + 1] = bins.get(low + 1, 0) + t - low
    return sum(v * v for v in bins.values()) / len(points)


def slow_angle(points):
    """(points, vertical, candidate, score, angle), None for fewer than four points."""
    if len(points) < 4:
        return None
    coarse, tops = [a * 3.0 for a in range(-15, 16)], {}
    rank = lambda s: (s[1], -abs(s[0]), -s[0])
    for v in (False, True):
        scores = {a: round(slow_sharpness(points, v, a), 9) for a in coarse}
        for p in sorted(coarse, key=lambda a: (scores[a], a))[-3:]:
            for a in [p + k / 2 for k in range(-6, 7)]:
                if abs(a) <= 45 and a not in scores:
                    scores[a] = round(slow_sharpness(points, v, a), 9)
        tops[v] = scores, max(scores.items(), key=rank)
    (_, h), (_, v) = tops[False][1], tops[True][1]
    way = v > h
    scores, (angle, score) = tops[way]
    good = (abs(angle) >= 3 and len(points) >= 24 and score >= 1.1 * scores[0.0] and (abs(v - h) > 0.05 * max(v, h) or abs(angle) < 43)
            and not any(s >= 0.98 * score and abs(a - angle) >= 5 for a, s in scores.items()))
    if good:
        turn = math.radians(angle)
        along = [y * math.cos(turn) - x * math.sin(turn) if way else x * math.cos(turn) + y * math.sin(turn) for x, y in points]
        low, long, favour = min(along), max(along) + 1 - min(along), 0
        for section in range(3):
            part = [p for p, u in zip(points, along) if min(math.floor((u - low) * 3 / long), 2) == section]
            if len(part) >= 12:
                found = {a: round(slow_sharpness(part, way, a), 9) for a in {*coarse, angle, angle - 1, angle + 1}}
                near = max(found.items(), key=rank)
                gain = found[angle] / found[0.0]
                good = good and not (gain < 0.9 and len(part) >= 0.2 * len(points))
                favour += gain >= 1.03 and (abs(near[0] - angle) <= 3 or found[angle] >= 0.97 * near[1])
        good = good and favour >= 2
    return len(points), way, angle, round(score, 6), angle if good else 0.0


def test_text_angles_against_plain_code_in_one_pass(spark, monkeypatch):
    rng, clouds = random.Random(11), {}
    for k in range(60):
        turn, upright, n = math.radians(rng.choice([0, 4, 9.5, -17, 31, 44])), rng.random() < 0.4, rng.choice([1, 3, 4, 13, 30, 90, 260])
        clouds[k] = []
        for _ in range(n):
            u, v = rng.uniform(0, 120), rng.randrange(5) * 13 + rng.uniform(0, rng.choice([2, 9]))
            u, v = (v, u) if upright else (u, v)
            clouds[k].append((round(u * math.cos(turn) - v * math.sin(turn), 1), round(u * math.sin(turn) + v * math.cos(turn), 1)))
        clouds[k] += clouds[k][:n // 5]
    points = spark.createDataFrame([(k, *p) for k, ps in clouds.items() for p in ps], "k long, px double, py double").repartition(3)
    for votes in (1 << 17, 500):
        monkeypatch.setattr("pageloom.operators.angles.VOTES", votes)
        found = angle_search(points, "k")
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        got = {r.k: (r.points, r.vertical, r.candidate, r.score, r.angle) for r in found.collect()}
        want = {k: slow_angle(ps) for k, ps in clouds.items()}
        want = {k: w for k, w in want.items() if w}
        assert got.keys() == want.keys() and all(g[3] == pytest.approx(want[k][3], abs=2e-6) for k, g in got.items())
        assert {k: g[:3] + g[4:] for k, g in got.items()} == {k: w[:3] + w[4:] for k, w in want.items()}
    assert sum(g[4] != 0 for g in got.values()) >= 5
    odd = points.limit(0).unionByName(spark.createDataFrame([(1, None, 1.0)] * 5 + [(2, 1.0, 1.0)] * 3 + [(2, 1.0, None)], points.schema))
    assert [(r.k, r.points) for r in angle_search(odd, "k").collect()] == [(2, 4)]
    assert angle_search(points.where("false"), "k").count() == 0


def slow_parts(profile, height):
    """(start, stop, ink) of one mask by the rule, position by position."""
    start, end = min(profile), max(profile) + 1
    islands, at = [], start
    while at < end:
        stop = at
        while profile.get(stop) == 0:
            stop += 1
        if at < stop and start < at and stop < end:
            islands.append((at, stop))
        at = max(stop, at + 1)
    if not islands:
        return []
    sizes = sorted(b - a for a, b in islands)
    normal = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    cuts = [start] + [(a + b) // 2 for a, b in islands if b - a >= max(4.0, height * 0.9, normal * 1.8)]
    parts = [(a, b, sum(profile.get(p) or 0 for p in range(a, b))) for a, b in zip(cuts, cuts[1:] + [end])] if len(cuts) > 1 else []
    return [] if any(p[2] < 4 * height * height for p in parts) else parts


def test_gutters_against_plain_code_in_one_pass(spark):
    rng, masks = random.Random(5), {}
    for k in range(400):
        profile, at = {}, rng.randrange(-9, 30)
        for _ in range(rng.randrange(1, 9)):
            for v in [rng.randrange(1, 40)] * rng.randrange(1, 20) + [0] * rng.choice([0, 1, 2, 2, 3, 9, 14]):
                profile[at] = v
                at += 1
            at += rng.random() < 0.05  # a line without a row
        if k % 50 == 0:
            profile[at] = None
        masks[k] = profile
    heights = {k: rng.choice([1.0, 2.5, 4.0]) for k in masks if k % 7}
    rows = spark.createDataFrame([(k, p, v) for k, ps in masks.items() for p, v in ps.items()], "mask_id long, pos long, ink long").repartition(4)
    typical = spark.createDataFrame(list(heights.items()), "mask_id long, height double")
    found = O.split_gutters(rows, typical)
    assert sum("Join" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    want = [(k, *p) for k, h in heights.items() for p in slow_parts(masks[k], h)]
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == sorted(want)
    halves = O.split_gutters(rows.withColumn("ink", F.col("ink") / 2), typical.withColumn("height", F.col("height") / 2))
    assert sorted(map(tuple, halves.where("mask_id < 0").collect())) == [] and halves.schema["ink"].dataType.typeName() == "double"
    assert O.split_gutters(rows.where("false"), typical).count() == 0


def slow_panel_order(texts, panels):
    """Rows (page, id, seq, x, y, w, h) of one page in reading order."""
    def home(t):
        x, y = t[3] + t[5] / 2, t[4] + t[6] / 2
        held = [p for p in panels if p[3] <= x <= p[3] + p[5] and p[4] <= y <= p[4] + p[6]]
        return held[0][1] if len(held) == 1 else None
    homes = {t[1]: home(t) for t in texts}
    used = {h for h in homes.values() if h is not None}
    if len(used) < 2 or sum(h is not None for h in homes.values()) < 0.6 * len(texts):
        return slow_reading_order(texts)
    frames = sorted((p for p in panels if p[1] in used), key=lambda p: p[2]) + sorted((t for t in texts if homes[t[1]] is None), key=lambda t: t[2])
    out = []
    for cell in O._cells(np.array([f[3:] for f in frames], float)):
        for f in slow_reading_order([frames[i] for i in cell]):
            out += slow_reading_order([t for t in texts if homes[t[1]] == f]) if f in used else [f]
    return out


def test_panel_order_against_plain_code_in_one_pass(spark, tmp_path):
    rng, texts, panels = random.Random(8), [], []
    for page in range(80):
        for i in range(rng.randint(0, 5)):
            panels.append((page, 1000 + i, rng.randrange(10**6), rng.randrange(3) * 300, rng.randrange(4) * 260, rng.choice([280, 290, 590]), rng.choice([250, 300])))
        for i in range(rng.randint(1, 16)):
            texts.append((page, i, rng.randrange(10**6), rng.randrange(800), rng.randrange(1000), rng.randint(20, 120), rng.randint(20, 120)))
    frame(spark, texts).write.parquet(str(tmp_path / "texts"))
    frame(spark, panels).write.parquet(str(tmp_path / "panels"))
    dealt = [spark.read.parquet(str(tmp_path / n)).repartition(7, "image_id") for n in ("texts", "panels")]
    found = O.panel_reading_order(*dealt)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.image_id, r.position)):
        got.setdefault(r.image_id, []).append(r.region_id)
        assert r.position == len(got[r.image_id])
    of = lambda rows, page: [r for r in rows if r[0] == page]
    want = {page: slow_panel_order(of(texts, page), of(panels, page)) for page in range(80)}
    assert got == want and sum(w != slow_reading_order(of(texts, p)) for p, w in want.items()) >= 5
    assert O.panel_reading_order(dealt[0].where("false"), dealt[1]).count() == 0
