from random import Random

from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import text as X
from pageloom.plans import QUERIES
from tests.conftest import SMALL


def runs_by_cells(c, cell):
    starts = lambda f: F.transform(f, lambda v, i: v & ~F.coalesce(F.get(f, i - 1), F.lit(False)))
    return X.let(F.transform(X.graphemes(c), cell), lambda f: F.size(F.filter(starts(f), lambda v: v)))


def test_runs_equal_those_of_single_cells(spark):
    parts = ["a", "Z9", "'", "’", "_", " ", "\r\n", "\r", "\n", ".", ",", '"', ")", "é", "é", "́", "×", "÷", "ß", "жи", "Ω", "日本", "ゃ", "が", "が",
             "。", ".́", "…", "‍", "👩‍👩", "🇩🇪", "؀", "ب", "가", "한", "ー", "〪", "١", "﻿", "", "ǅ", "ʰ"]
    rng = Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "x" * 30000, "日" * 30000, ("é" * 5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    sticky = F.array(*[F.lit(x) for x in X.CLOSING + '"'])
    got = rows.select("t", X.word_count(F.col("t")).alias("w"), X.chunk_count(F.col("t")).alias("k"), runs_by_cells(F.col("t"), X.is_word).alias("w1"),
                      runs_by_cells(F.col("t"), lambda g: X.is_word(g) | F.array_contains(sticky, g)).alias("k1")).collect()
    assert all((r.w, r.k) == (r.w1, r.k1) for r in got), [r for r in got if (r.w, r.k) != (r.w1, r.k1)][:3]


def test_shapes_on_odd_polygons(spark):
    nan = float("nan")
    square, bow = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 8)]
    dent = [(0, 0), (8, 0), (8, 8), (4, 1), (0, 8)]
    star = [(0, 0), (8, 6), (0, 6), (8, 0), (4, 9)]
    shapes = [square, bow, dent, star, None, [], square[:2], [*square, (0, 0)], [(0, 0), (4, 0), (8, 0)], [(0, 0), (nan, 0), (4, 4)], [(0, 0), (None, 0), (4, 4)],
              [(1, 1)] * 2001, [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (9, 0), (9, 9), (8, 1)]]
    why = [None, "self_crossing", None, "self_crossing", "count", "count", "count", "repeated_vertex", "degenerate", "not_finite", "not_finite", "count", None, None]
    table = [(i, s and [{"x": None if a is None else float(a), "y": float(b)} for a, b in s] if s else s) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(table, "i int, p array<struct<x:double,y:double>>").repartition(3)
    got = {r.i: r for r in df.select("i", G.invalid_reason("p").alias("why"), G.order_quad("p").alias("quad"),
                                     G.point_in_polygon(F.col("p"), F.lit(4), F.lit(2)).alias("inside")).collect()}
    assert [got[i].why for i in range(len(shapes))] == why
    assert {i for i in got if got[i].quad} == {0, 1} and [tuple(c) for c in got[0].quad] == square
    assert [got[i].inside for i in (0, 2, 4, 5, 9, 10)] == [True, False, None, False, None, None]


def test_no_shape_query_is_interpreted(spark):
    plan = lambda name: QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("f04_word_count", "f23_order_quad", "f29_point_in_polygon"):
        assert "lambda" not in plan(name), name
    assert "exists(" not in plan("f25_normalise_frames")
