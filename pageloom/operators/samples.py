"""Colour, contrast, residual and projection statistics over sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core import ranking

_c = F.col


def colour_mode(samples: DataFrame, key: str) -> DataFrame:
    """Modal colour of each group and the share of samples within 12 of it, over all samples.

    Channels are small integers, so the exact medians keep a count per value.
    """
    bin_of = lambda c: F.least(F.floor(_c(c) / 8), F.lit(31))
    binned = samples.withColumn("_bin", bin_of("r") * 1024 + bin_of("g") * 32 + bin_of("b"))
    sizes = binned.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_size"))
    mode = sizes.groupBy(key).agg(F.min_by("_bin", F.struct((-_c("_size")).alias("s"), "_bin")).alias("_bin"))
    centre = binned.join(mode, [key, "_bin"]).groupBy(key).agg(*[F.median(c).alias(f"_{c}") for c in "rgb"])
    near = F.sqrt(sum((F.pow(_c(c) - _c(f"_{c}"), F.lit(2.0)) for c in "rgb"), F.lit(0.0))) <= 12
    return binned.join(centre, key).groupBy(key).agg(
        *[F.median(F.when(near, _c(c))).alias(c) for c in "rgb"],
        F.avg(F.when(near, 1.0).otherwise(0.0)).alias("support"), F.count(F.lit(1)).alias("used"))


def uniformity(samples: DataFrame, colours: DataFrame, key: str) -> DataFrame:
    """Is every group one flat colour?  Spread quantiles use linear interpolation."""
    picked = colours.select(key, "support", *[_c(c).alias(f"_{c}") for c in "rgb"])
    spread = F.greatest(*[F.abs(_c(c) - _c(f"_{c}")) for c in "rgb"])
    ranks = ranking.value_ranks(samples.join(picked, key).withColumn("spread", spread), [key], "spread",
                                F.floor(_c("spread") / 4))
    q = ranks.groupBy(key).agg(F.max("total").alias("samples"), ranking.quantile("spread", 0.95).alias("p95"),
                               ranking.quantile("spread", 0.99).alias("p99"))
    return q.join(picked.select(key, "support"), key).withColumn(
        "uniform", (_c("samples") >= 32) & (_c("support") >= 0.6) & (_c("p95") <= 4) & (_c("p99") <= 10))


def residual_counts(pixels: DataFrame, key: str) -> DataFrame:
    """Confirmed residue in and around each mask, and unconfirmed doubt."""
    counts = pixels.groupBy(key).agg(
        F.count_if(_c("confirmed") & _c("in_mask")).alias("inside"),
        F.count_if(_c("confirmed") & _c("in_inspection") & ~_c("in_mask")).alias("outside"),
        F.count_if(_c("raw") & _c("in_inspection") & ~_c("confirmed")).alias("uncertain"))
    return counts.withColumn("status", F.when((_c("inside") > 0) | (_c("outside") > 0), "residual")
                             .when(_c("uncertain") > 0, "uncertain").otherwise("passed"))


def retry_accept(first: DataFrame, second: DataFrame, page: str, key: str, structure: DataFrame) -> DataFrame:
    """Accept a second repair only for a real drop with no region worse and structure intact."""
    names = ["inside", "outside", "uncertain"]
    was = first.select(page, key, *[_c(n).alias(f"_{n}") for n in names])
    worse = F.lit(False)
    for n in names:
        worse = worse | (_c(n) > _c(f"_{n}"))
    both = second.select(page, key, *names).join(was, [page, key]).groupBy(page).agg(
        F.sum("_inside").alias("initial"), F.sum("inside").alias("final"), F.bool_or(worse).alias("regressed"))
    need = F.greatest(F.lit(3), F.ceil(_c("initial") * 0.2))
    return both.join(structure, page).withColumn(
        "accepted", (_c("initial") - _c("final") >= need) & ~_c("regressed") & ~_c("damaged"))


def ink_polarity(samples: DataFrame, key: str) -> DataFrame:
    """Was the lettering dark or light?  ``samples``: luminance, ink, border."""
    sets = F.array_compact(F.array(
        F.lit("all"), F.when(~_c("ink"), "open"), F.when(~_c("ink") & _c("border"), "edge"), F.when(_c("ink"), "ink")))
    ranks = ranking.value_ranks(samples.select(key, "luminance", F.explode(sets).alias("_set")), [key, "_set"],
                                "luminance", F.floor(_c("luminance") * 64))
    q = ranks.groupBy(key, "_set").agg(
        F.max("total").alias("n"), ranking.quantile("luminance", 0.5).alias("q50"),
        ranking.quantile("luminance", 0.15).alias("q15"), ranking.quantile("luminance", 0.85).alias("q85"))
    at = lambda s, c: F.max(F.when(_c("_set") == s, _c(c)))
    wide = q.groupBy(key).agg(
        F.coalesce(at("edge", "q50"), at("open", "q50"), at("all", "q50")).alias("base"),
        F.coalesce(at("ink", "n"), F.lit(0)).alias("ink_pixels"), at("all", "n").alias("pixels"),
        at("ink", "q15").alias("_low"), at("ink", "q85").alias("_high"))
    further = F.when(F.abs(_c("_low") - _c("base")) > F.abs(_c("_high") - _c("base")), _c("_low")).otherwise(_c("_high"))
    enough = (_c("ink_pixels") >= 8) & (_c("ink_pixels") < 0.8 * _c("pixels"))
    fill = F.when(enough & (F.abs(further - _c("base")) >= 0.12),
                  F.when(further < _c("base"), "#000000").otherwise("#ffffff"))
    return wide.select(key, "base", "ink_pixels", fill.alias("fill"))


def contrast_choice(samples: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Readable fill and outline.  ``samples``: luminance; ``hints``: fill, font_size."""
    black, white = (_c("luminance") + 0.05) / 0.05, 1.05 / (_c("luminance") + 0.05)
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value"))
                                for n, v in (("luminance", _c("luminance")), ("#000000", black), ("#ffffff", white))]))
    long = samples.select(key, kinds.alias("_k")).select(key, "_k.*")
    q = ranking.value_ranks(long, [key, "kind"], "value", F.floor(_c("value") * 16)).groupBy(key, "kind").agg(
        ranking.quantile("value", 0.2).alias("q20"), ranking.quantile("value", 0.5).alias("q50"))
    at = lambda s, c: F.max(F.when(_c("kind") == s, _c(c)))
    wide = q.groupBy(key).agg(
        at("luminance", "q50").alias("median"),
        *[at(k, c).alias(f"_{n}_{c}") for k, n in (("#000000", "b"), ("#ffffff", "w")) for c in ("q20", "q50")])
    mix = samples.groupBy(key).agg(
        ((F.avg(F.when(_c("luminance") < 0.12, 1.0).otherwise(0.0)) >= 0.15)
         & (F.avg(F.when(_c("luminance") > 0.5, 1.0).otherwise(0.0)) >= 0.15)).alias("complex"))
    best = F.when(1.05 / (_c("median") + 0.05) > (_c("median") + 0.05) / 0.05, "#ffffff").otherwise("#000000")
    of = lambda c, fill: F.when(fill == "#000000", _c(f"_b_{c}")).otherwise(_c(f"_w_{c}"))
    fill = F.when(_c("hint").isNotNull() & (of("q20", _c("hint")) >= 4.5), _c("hint")).otherwise(best)
    outlined = _c("complex") | (of("q20", _c("fill")) < 4.5)
    width = F.greatest(F.lit(1), F.least(F.lit(3), F.bround(_c("font_size") * 0.06, 0))).cast("bigint")
    return (wide.join(mix, key).join(hints, key).withColumn("fill", fill)
            .select(key, "fill", F.round("median", 4).alias("median"), F.round(of("q50", _c("fill")), 3).alias("contrast"),
                    F.when(outlined, width).otherwise(F.lit(0)).cast("bigint").alias("stroke_width")))


def tilted(angle: Column, vertical: Column) -> Column:
    """The coordinate of (px, py) across the text lines at an angle in degrees."""
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.when(vertical, _c("px") * cos + _c("py") * sin).otherwise(_c("py") * cos - _c("px") * sin)


def projection_score(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of squared soft-histogram bins per point, of the coordinate ``t``.

    Each point splits its weight over the two nearest bins; bins add up before
    the shuffle.
    """
    low = F.floor("t")
    bins = F.explode(F.array(F.struct(low.alias("bin"), (1 - (_c("t") - low)).alias("weight"), F.lit(1).alias("one")),
                             F.struct((low + 1).alias("bin"), (_c("t") - low).alias("weight"), F.lit(0).alias("one"))))
    return (points.select(*keys, bins.alias("_b")).groupBy(*keys, "_b.bin")
            .agg(F.sum("_b.weight").alias("_h"), F.sum("_b.one").alias("_n"))
            .groupBy(*keys).agg(F.sum("_n").alias("points"), (F.sum(_c("_h") * _c("_h")) / F.sum("_n")).alias("score")))


def removal_eval(pixels: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Dark pixels left, detections still over the mask and damage outside it."""
    m = _c("in_mask")
    p = pixels.groupBy(key).agg(
        F.count_if(m).alias("mask_pixels"), F.count_if(m & (_c("before") < 128)).alias("dark_before"),
        F.count_if(m & (_c("after") < 128)).alias("dark_after"),
        F.count_if(~m & (_c("before") != _c("after"))).alias("changed_outside"),
        F.coalesce(F.max(F.when(~m, F.abs(_c("after") - _c("before")))), F.lit(0)).alias("max_delta_outside"))
    over = (_c("area") > 0) & (_c("overlap") >= 0.2 * _c("area"))
    b = boxes.groupBy(key).agg(F.count_if(over & (_c("moment") == "before")).alias("boxes_before"),
                               F.count_if(over & (_c("moment") == "after")).alias("boxes_after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return p.join(b, key, "left").select(
        *[c for c in p.columns], zero("boxes_before"), zero("boxes_after"),
        F.round(1 - _c("dark_after") / F.greatest(F.lit(1), "dark_before"), 4).alias("reduction"))
