"""Timings, windows, batch counts and review counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core import ranking
from pageloom.functions import text as X

_c = F.col


def stage_timings(samples: DataFrame, last: int = 100) -> DataFrame:
    """Count, mean and p95 per stage of the newest ``last`` samples overall."""
    recent = samples.orderBy(F.desc("ts_us"), F.desc("sample_id")).limit(last)
    values = F.sort_array(F.collect_list("seconds"))  # at most ``last`` rows
    return recent.groupBy("stage").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("seconds"), 3).alias("mean_seconds"),
        F.element_at(values, F.least(F.count(F.lit(1)), F.floor(F.count(F.lit(1)) * 0.95) + 1).cast("int")).alias("p95_seconds"))


def window_stats(samples: DataFrame, window_seconds: int, min_seconds: float = 30, min_samples: int = 8) -> DataFrame:
    """Throughput and p95 latency per unit, per kind and tumbling window.

    ``samples``: kind, ts_us (end), elapsed seconds, units.
    """
    size = window_seconds * 1_000_000
    s = (samples.withColumn("window_start_us", _c("ts_us") - F.pmod("ts_us", F.lit(size)))
         .withColumn("_units", F.greatest(F.lit(0.1), "units"))
         .withColumn("latency", F.greatest(F.lit(0.001), "elapsed") / _c("_units")))
    keys = ["kind", "window_start_us"]
    started = F.min_by(_c("ts_us") - F.round(_c("elapsed") * 1e6).cast("bigint"), "ts_us")
    totals = s.groupBy(*keys).agg(
        F.sum("_units").alias("_units"), ((F.max("ts_us") - started) / 1e6).alias("duration"),
        F.count(F.lit(1)).alias("samples"))
    ranks = ranking.value_ranks(s, keys, "latency", F.floor(_c("latency") * 4))
    p95 = ranks.groupBy(*keys).agg(
        ranking.value_at("latency", F.ceil(_c("total") * 0.95) - 1).alias("p95"))
    return totals.join(p95, keys).select(
        *keys, "samples", "duration", (_c("_units") / F.greatest(F.lit(0.001), "duration")).alias("throughput"), "p95",
        ((_c("duration") >= min_seconds) & (_c("samples") >= min_samples)).alias("ready"))


def probe_verdict(windows: DataFrame) -> DataFrame:
    """Keep or revert each ready window against the ready one before it."""
    ready = windows.where("ready")
    pairs = ranking.previous_row(ready, ["kind"], ["window_start_us"],
                                 F.floor(_c("window_start_us") / 86_400_000_000), ["throughput", "p95"], "base_")
    good = (_c("throughput") >= _c("base_throughput") * 1.1) & (_c("p95") <= _c("base_p95") * 1.2)
    return pairs.where("base_p95 is not null").withColumn("verdict", F.when(good, "keep").otherwise("revert"))


def timing_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds (never negative) and calls per name."""
    return events.groupBy(*keys, "name").agg(
        F.round(F.sum(F.greatest(F.lit(0.0), "seconds")), 6).alias("seconds"), F.count(F.lit(1)).alias("calls"))


def timing_map(totals: DataFrame, keys: list[str]) -> DataFrame:
    """The totals as one map per key; one entry per timer name."""
    entry = F.struct("name", F.struct("seconds", "calls"))
    return totals.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("timings"))


def batch_status(tasks: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts per status, waiting, missing and progress of every batch."""
    states = ["QUEUED", "RUNNING", "CANCELLING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"]
    n = tasks.groupBy("batch_id").agg(
        *[F.count_if(_c("status") == s).alias(s.lower()) for s in states],
        F.count_if((_c("status") == "QUEUED") & _c("waiting_reason").isNotNull()).alias("waiting"),
        F.count(F.lit(1)).alias("_all"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return batches.join(n, "batch_id", "left").select(
        "batch_id", "total", *[zero(s.lower()).alias(s.lower()) for s in states], zero("waiting").alias("waiting"),
        F.greatest(F.lit(0), _c("total") - zero("_all")).alias("missing"),
        F.when(_c("total") > 0, zero("completed") / _c("total")).otherwise(0.0).alias("progress"))


def run_counts(reviews: DataFrame) -> DataFrame:
    """passed / issues / unverified / stale / pending pages of every run."""
    names = ["passed", "issues", "unverified", "stale", "pending"]
    return reviews.groupBy("run_id").agg(*[F.count_if(_c("review_status") == n).alias(n) for n in names])


def batch_summary(pages: DataFrame) -> DataFrame:
    """Task and review work left per run."""
    st = _c("status")
    return pages.groupBy("run_id").agg(
        F.count_if(st == "QUEUED").alias("queued"), F.count_if(st.isin("RUNNING", "CANCELLING")).alias("running"),
        F.count_if(st == "PAUSED").alias("paused"), F.count_if(st == "COMPLETED").alias("completed"),
        F.count_if(st == "FAILED").alias("failed"), F.count_if(st == "CANCELLED").alias("cancelled"),
        F.count_if("review_ready").alias("review_ready"), F.count_if("correction_open").alias("correction_pending"),
        F.count_if("text_pending").alias("text_pending"))


def merge_regions(members: DataFrame) -> DataFrame:
    """One region per (image_id, group_id): united frames, joined texts, weakest confidence."""
    tx, ty = F.coalesce("tx", "x"), F.coalesce("ty", "y")
    tw, th = F.coalesce("tw", "w"), F.coalesce("th", "h")
    place = F.struct("reading_order", "region_id")

    def joined(name: str) -> Column:
        texts = F.transform(F.array_sort(F.collect_list(F.when(_c(name) != "", F.struct(place.alias("p"), _c(name).alias("t"))))),
                            lambda v: v["t"])
        return F.when(F.min_by("orientation", place) == "vertical", F.array_join(texts, "")).otherwise(F.array_join(texts, " "))

    def span(lo: Column, size: Column, low: str, length: str) -> list[Column]:
        return [F.min(lo).alias(low), (F.max(lo + size) - F.min(lo)).alias(length)]
    return members.groupBy("image_id", "group_id").agg(
        F.min_by("region_id", place).alias("region_id"), F.count(F.lit(1)).alias("merged"),
        *span(_c("x"), _c("w"), "x", "w"), *span(_c("y"), _c("h"), "y", "h"),
        *span(tx, tw, "tx", "tw"), *span(ty, th, "ty", "th"),
        joined("source_text").alias("source_text"), joined("translated_text").alias("translated_text"),
        F.min("confidence").alias("confidence"), F.bool_or("visible").alias("visible"),
        F.lit(0.0).alias("rotation")).where("merged >= 2")


def assemble_chunks(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Regions whose every chunk arrived: ordered text, weakest confidence, blank chunk indexes."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    got = chunks.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("chunks"), ordered.alias("_parts"), F.min("confidence").alias("confidence"))
    return got.join(expected, "region_id").where(_c("chunks") == _c("expected")).select(
        "region_id", "chunks", "confidence",
        F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"),
        F.transform(F.filter("_parts", lambda p: X.strip(p["text"]) == ""), lambda p: p["chunk_index"]).alias("empty_chunks"))


def next_attempt(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("workflow_id", "stage").agg((F.max("attempt") + 1).alias("next_attempt"))


def next_region_key(regions: DataFrame) -> DataFrame:
    """First free ``R%03d`` at or after the page's region count plus one."""
    counts = regions.groupBy("image_id").agg((F.count(F.lit(1)) + 1).alias("_first"))
    number = F.regexp_extract("region_key", r"^R(\d+)$", 1).try_cast("bigint")
    used = regions.select("image_id", number.alias("n"), "region_key").where("n is not null").distinct()
    free = (used.join(counts, "image_id").where("n >= _first").select("image_id", (_c("n") + 1).alias("n"))
            .union(counts.select("image_id", _c("_first").alias("n")))
            .withColumn("region_key", F.format_string("R%03d", "n"))
            .join(used.select("image_id", "region_key"), ["image_id", "region_key"], "left_anti"))
    return free.groupBy("image_id").agg(F.min_by("region_key", "n").alias("next_key"))


def review_latency(reviews: DataFrame) -> DataFrame:
    seconds = F.greatest(F.lit(0.0), (_c("reviewed_us") - _c("claimed_us")) / 1e6)
    return reviews.where("outcome is not null").groupBy("worker").agg(
        F.count(F.lit(1)).alias("reviews"), F.round(F.avg(seconds), 3).alias("mean_seconds"), F.max(seconds).alias("max_seconds"))


def queue_seconds(runs: DataFrame) -> DataFrame:
    """Time each attempt waited since its task last changed."""
    return runs.withColumn("queue_seconds", F.greatest(F.lit(0.0), (_c("started_us") - _c("updated_us")) / 1e6))


def storage_reclaimed(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def change_token(operations: DataFrame, updates: DataFrame) -> DataFrame:
    """One "completed operations : newest change" token per project."""
    done = operations.where("status = 'COMPLETED'").groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    newest = updates.groupBy("project_id").agg(F.max("updated_us").alias("_u"))
    return newest.join(done, "project_id", "left").select("project_id", F.concat_ws(
        ":", F.coalesce("_n", F.lit(0)).cast("string"), _c("_u").cast("string")).alias("token"))


def unknown_cloud(checkpoints: DataFrame) -> DataFrame:
    """Per workflow: unknown outcomes, and which branches are safely saved."""
    ok = lambda s: F.bool_or((_c("status") == "SUCCEEDED") & (_c("stage") == s))
    saved = F.array_compact(F.array(F.when(ok("translation"), "translation"),
                                    F.when(ok("mask") & ok("inpainting"), "repair")))
    return checkpoints.groupBy("workflow_id").agg(
        F.count_if(_c("status") == "UNKNOWN").alias("unknown"), F.array_join(saved, ",").alias("saved"))


def detection_report(regions: DataFrame) -> DataFrame:
    kept = _c("label") == "text"
    return regions.groupBy("image_id").agg(
        F.count_if(kept).alias("text_regions"), F.count_if(_c("label") == "onomatopoeia").alias("excluded_sfx"),
        F.count_if(kept & _c("bubble_id").isNotNull()).alias("associated_text_regions"),
        F.countDistinct(F.when(kept, _c("bubble_id"))).alias("associated_bubbles"))


def coordination_counts(pages: DataFrame, now_us: int) -> DataFrame:
    """Claimable, claimed, waiting and correcting pages of every run."""
    reviews = ("preflight_review", "final_review", "stale_review", "delivery_decision", "preflight_unresolved",
               "failed", "cancelled")
    fixing = ("correction_available", "correcting")
    live = F.coalesce(_c("lease_expires_us") > now_us, F.lit(False))
    ready = _c("stage").isin(*reviews) | (_c("stage").isin(*fixing) & _c("allowed"))
    return pages.groupBy("run_id").agg(
        F.count_if(~live & ready).alias("claimable"), F.count_if(live).alias("claimed"),
        F.count_if(_c("stage").isin("waiting", "paused")).alias("waiting"),
        F.count_if(_c("stage").isin(*fixing)).alias("correction_pending"))
