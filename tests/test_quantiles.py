"""Interpolated quantiles round as the checking SQL does."""

import math
import random

from pyspark.sql import functions as F

from pageloom.core.ranking import fused
from pageloom.operators import samples


def test_fused_rounds_once(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(250) / 250, rng.random(), rng.randrange(250) / 250 * rng.random()) for _ in range(2000)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select(fused(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [math.fma(a, b, c) for a, b, c in rows]


def test_polarity_of_ties_follows_sql(spark, duck):
    rng = random.Random(3)
    rows = [(k, rng.randrange(250) / 250, i % 3 == 0, i < 8 or i >= 56) for k in range(3000) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, luminance double, ink boolean, border boolean")
    got = {r.vec_id: r.fill for r in samples.ink_polarity(df, "vec_id").collect()}
    duck.register("lm", df.toPandas())
    want = dict(duck.execute("""with q as (select vec_id, median(luminance) filter (border and not ink) base,
        quantile_cont(luminance, 0.15) filter (ink) lo, quantile_cont(luminance, 0.85) filter (ink) hi from lm group by 1),
      f as (select *, case when abs(lo - base) > abs(hi - base) then lo else hi end far from q)
      select vec_id, case when abs(far - base) >= 0.12 then case when far < base then '#000000' else '#ffffff' end end from f""").fetchall())
    duck.unregister("lm")
    assert got == want
