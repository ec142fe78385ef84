"""A-01..A-33 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import areas, lineage, samples, telemetry, versions
from pageloom.plans.filters import ACTIVE, NOW_US, WORK_SQL, _text_work  # noqa: F401
from pageloom.plans.joins import _ORPHANS, _CK, checkpoints, orphans
from pageloom.plans.registry import query

_c = F.col


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("a01_stage_timings", """
  with last as (select * from events_log order by ts_us desc, event_id desc limit 100)
  select event_type as stage, count(*) as samples, round(avg(seconds), 3) as mean_seconds,
    (list_sort(list(seconds)))[least(count(*), cast(floor(count(*) * 0.95) as bigint) + 1)] as p95_seconds from last group by 1""")
def _a01(t):
    return telemetry.stage_timings(t.events_log.selectExpr("event_id as sample_id", "event_type as stage", "ts_us", "seconds"))


_WIN = """w as (select event_type as kind, ts_us, ts_us - ts_us % 86400000000 as window_start_us, centis / 100.0 as elapsed,
    greatest(0.1, k / 10.0) as u, greatest(0.001, centis / 100.0) / greatest(0.1, k / 10.0) as latency from events_log),
  g as (select kind, window_start_us, sum(u) units, count(*) n, list_sort(list(latency)) l,
    (max(ts_us) - arg_min(ts_us - cast(round(elapsed * 1e6) as bigint), ts_us)) / 1e6 as duration from w group by 1, 2),
  win as (select kind, window_start_us, n as samples, duration, units / greatest(0.001, duration) as throughput,
    l[cast(ceil(n * 0.95) as bigint)] as p95, duration >= 30 and n >= 8 as ready from g)"""


def _windows(t):
    s = t.events_log.selectExpr("event_type as kind", "ts_us", "centis / 100.0 as elapsed", "k / 10.0 as units")
    s = s.select("kind", "ts_us", *[_c(n).cast("double").alias(n) for n in ("elapsed", "units")])
    return telemetry.window_stats(s, 86400)


@query("a02_window_stats", f"""with {_WIN} select kind, window_start_us, samples, round(duration, 6) as duration,
  round(throughput, 9) as throughput, round(p95, 6) as p95, ready from win""")
def _a02(t):
    return _windows(t).select("kind", "window_start_us", "samples", F.round("duration", 6).alias("duration"),
                              F.round("throughput", 9).alias("throughput"), F.round("p95", 6).alias("p95"), "ready")


@query("a03_probe_verdict", f"""with {_WIN}, l as (select *, lag(throughput) over o bt, lag(p95) over o bp from win where ready
    window o as (partition by kind order by window_start_us))
  select kind, window_start_us, case when throughput >= bt * 1.1 and p95 <= bp * 1.2 then 'keep' else 'revert' end as verdict
  from l where bp is not null""")
def _a03(t):
    return telemetry.probe_verdict(_windows(t)).select("kind", "window_start_us", "verdict")


@query("a04_timing_totals", """
  with n as (select user_id as workflow_id, event_type as name, round(sum(greatest(0.0, seconds)), 6) s, count(*) c from events_log group by 1, 2)
  select workflow_id, string_agg(concat(name, '=', c), ',' order by name) as calls, round(sum(s), 4) as seconds from n group by 1""")
def _a04(t):
    totals = telemetry.timing_totals(t.events_log.selectExpr("user_id as workflow_id", "event_type as name", "seconds"), ["workflow_id"])
    entries = F.map_entries("timings")
    return telemetry.timing_map(totals, ["workflow_id"]).select(
        "workflow_id",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["calls"].cast("string"))), ",").alias("calls"),
        F.round(F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"]["seconds"]), 4).alias("seconds"))


_STATES = ["QUEUED", "RUNNING", "CANCELLING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"]


@query("a05_batch_status", f"""
  with b as (select project_id as batch_id, count(*) + project_id % 3 as total from image_pages group by project_id)
  select b.batch_id, b.total, {', '.join(f"count(*) filter (status = '{s}') as {s.lower()}" for s in _STATES)},
    count(*) filter (status = 'QUEUED' and waiting_reason is not null) as waiting, greatest(0, b.total - count(task_id)) as missing,
    round(count(*) filter (status = 'COMPLETED') * 1.0 / b.total, 6) as progress
  from b left join processing_tasks t on b.batch_id = t.batch_id group by b.batch_id, b.total""")
def _a05(t):
    batches = t.image_pages.groupBy(_c("project_id").alias("batch_id")).agg(
        (F.count(F.lit(1)) + F.first("project_id") % 3).alias("total"))
    return telemetry.batch_status(t.processing_tasks, batches).withColumn("progress", F.round("progress", 6))


_OUTCOMES = ["passed", "issues", "unverified", "stale", "pending"]
_STATUS = """case when outcome is null then 'pending' when reviewed_version <> current_version then 'stale' else outcome end"""


@query("a06_run_counts", f"""select run_id, {', '.join(f"count(*) filter (({_STATUS}) = '{o}') as {o}" for o in _OUTCOMES)}
  from review_pages group by 1""")
def _a06(t):
    return telemetry.run_counts(lineage.stale_reviews(t.review_pages))


@query("a06_batch_summary", f"""
  with w as ({WORK_SQL})
  select run_id, count(*) filter (t.status = 'QUEUED') as queued, count(*) filter (t.status in ('RUNNING', 'CANCELLING')) as running,
    {', '.join(f"count(*) filter (t.status = '{s}') as {s.lower()}" for s in ('PAUSED', 'COMPLETED', 'FAILED', 'CANCELLED'))},
    count(*) filter (({_STATUS}) in ('pending', 'stale')) as review_ready, count(*) filter (correction_open) as correction_pending,
    count(*) filter (w.start_stage is not null) as text_pending
  from review_pages r join processing_tasks t using (image_id) join w using (image_id) group by 1""")
def _a06b(t):
    pages = (lineage.stale_reviews(t.review_pages).join(t.processing_tasks.select("image_id", "status"), "image_id")
             .join(_text_work(t).select("image_id", _c("start_stage").isNotNull().alias("text_pending")), "image_id")
             .withColumn("review_ready", _c("review_status").isin("pending", "stale")))
    return telemetry.batch_summary(pages)


_MEMBER = ["image_id", "region_id", "x", "y", "w", "h", "orientation", "reading_order", "source_text", "translated_text",
           "confidence", "visible", "locked as group_id", "case when overflow then null else x + 5 end as tx",
           "case when overflow then null else y end as ty", "case when overflow then null else w + 9 end as tw",
           "case when overflow then null else h end as th"]


@query("a09_merge_regions", f"""
  with m as (select {', '.join(_MEMBER)} from text_regions),
  g as (select image_id, group_id, arg_min(region_id, row(reading_order, region_id)) region_id, count(*) merged,
      min(x) x, max(x + w) - min(x) w, min(y) y, max(y + h) - min(y) h,
      min(coalesce(tx, x)) tx, max(coalesce(tx, x) + coalesce(tw, w)) - min(coalesce(tx, x)) tw,
      min(coalesce(ty, y)) ty, max(coalesce(ty, y) + coalesce(th, h)) - min(coalesce(ty, y)) th,
      arg_min(orientation, row(reading_order, region_id)) o, min(confidence) confidence, bool_or(visible) visible,
      list(source_text order by reading_order, region_id) filter (source_text <> '') st,
      list(translated_text order by reading_order, region_id) filter (translated_text <> '') tt
    from m group by 1, 2)
  select image_id, group_id, region_id, merged, x, w, y, h, tx, tw, ty, th,
    coalesce(case o when 'vertical' then array_to_string(st, '') else array_to_string(st, ' ') end, '') as source_text,
    coalesce(case o when 'vertical' then array_to_string(tt, '') else array_to_string(tt, ' ') end, '') as translated_text, confidence, visible,
    cast(0 as double) as rotation from g where merged >= 2""")
def _a09(t):
    return telemetry.merge_regions(t.text_regions.selectExpr(*_MEMBER))


_UNION = lambda src, keys: f"""e as (select distinct {keys}, unnest([x, x + w]) as p from {src}),
  s as (select {keys}, p as l, lead(p) over (partition by {keys} order by p) as r from e),
  c as (select s.*, y as y0, y + h as y1 from s join {src} q using ({keys}) where r is not null and q.x <= l and q.x + q.w >= r),
  m as (select *, max(y1) over (partition by {keys}, l order by y0, y1 rows between unbounded preceding and 1 preceding) as reach from c),
  u as (select {keys}, cast(sum((r - l) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) as bigint) area from m group by all)"""  # noqa: E731


@query("a10_union_area", f"with {_UNION('text_regions', 'image_id')} select image_id, area from u")
def _a10(t):
    return areas.union_area(t.text_regions, ["image_id"]).withColumn("area", _c("area").cast("bigint"))


_EVIDENCE = "case when locked then 'original' else 'rendered' end"


@query("a11_readable_coverage", f"""
  with ev as (select image_id, {_EVIDENCE} as kind, x, y, 3 * w as w, 4 * h as h, reading_order as scale from text_regions),
  seen as (select * from ev where scale <= 2), {_UNION('seen', 'image_id, kind')}
  select k.image_id, k.kind, round(coalesce(area, 0) / 1400000.0, 6) as coverage, coalesce(area, 0) / 1400000.0 >= 0.98 as ready
  from (select distinct image_id, kind from ev) k left join u using (image_id, kind) join image_pages using (image_id)""")
def _a11(t):
    ev = t.text_regions.selectExpr("image_id", f"{_EVIDENCE} as kind", "x", "y", "3 * w as w", "4 * h as h", "reading_order as scale")
    return areas.readable_coverage(ev, t.image_pages).withColumn("coverage", F.round("coverage", 6))


_REGION = ["image_id", "region_id", "x", "y", "w", "h", "source_text", "translated_text", "locked", "overflow", "bubble_id", "updated_us"]
_TEXT = ["region_id", "translated_text", "overflow"]
_SOURCE = ["region_id", "x", "y", "w", "h", "source_text"]
_REVIEW = ["image_id", "reviewed_version", "outcome", "deliver_with_issues", "correction_open"]
_JSON = lambda cols: "to_json({" + ", ".join(f"'{c}': {c}" for c in sorted(cols)) + "})"
_MULTI = lambda f: ("concat_ws(':', count(*), " + ", ".join(
    f"cast(sum(cast('0x' || substr({f}, {at}, 15) as bigint)) as varchar)" for at in (1, 16, 31)) + ")")


def _slim(t):
    return t.text_regions.select(*_REGION)


@query("a12_fingerprint", f"select image_id, region_id, sha256({_JSON(_REGION)}) as fingerprint from text_regions")
def _a12(t):
    return versions.row_fingerprint(_slim(t), ["image_id", "region_id"])


_PAGE = ["image_id", "project_id", "order_index", "width", "height", "exempt", "original_path", "clean_path", "rendered_path", "layer_path"]


@query("a12_page_version", f"""
  with f as (select image_id, sha256({_JSON(_REGION)}) f from text_regions), g as (select image_id, {_MULTI('f')} d from f group by 1)
  select p.image_id, sha256(concat({_JSON(_PAGE)}, '|', coalesce(d, '0'))) as version from image_pages p left join g using (image_id)""")
def _a12p(t):
    return versions.page_version(t.image_pages, _slim(t))


@query("a12_text_versions", f"""
  with f as (select image_id, sha256({_JSON(_SOURCE)}) s, sha256({_JSON(_TEXT)}) x from text_regions)
  select image_id, sha256({_MULTI('s')}) as source_version, sha256({_MULTI('x')}) as text_version from f group by 1""")
def _a12t(t):
    r = t.text_regions
    return versions.group_version(r, "image_id", _SOURCE, "source_version").join(
        versions.group_version(r, "image_id", _TEXT, "text_version"), "image_id")


@query("a12_delivery_version", f"""
  with f as (select run_id, sha256({_JSON(_REVIEW)}) f from review_pages)
  select run_id, sha256({_MULTI('f')}) as delivery_version from f group by 1""")
def _a12d(t):
    return versions.group_version(t.review_pages, "run_id", _REVIEW, "delivery_version")


# Samples: embedding values exploded to (group, position, value).
_SAMPLES = """smp as (select vec_id, label as grp, pos, cast(round(abs(cast(v as double)) * 1000) as bigint) as m,
    vec_id * 64 + pos as gpos from (select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding) as v from embeddings))"""
_RGB = ("190 + m % 60", "190 + (m * 3) % 50", "200 + m % 40")


def _samples(t):
    return t.raw("embeddings").select("vec_id", _c("label").alias("grp"), F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "grp", "pos", F.round(F.abs(_c("v").cast("double")) * 1000).cast("bigint").alias("m"),
        (_c("vec_id") * 64 + _c("pos")).alias("gpos"))


def _colours(t):
    s = _samples(t).selectExpr("vec_id", "pos", *[f"{e} as {n}" for n, e in zip("rgb", _RGB)])
    return s, samples.colour_mode(s, "vec_id")


_MODE = f"""{_SAMPLES}, rgb as (select vec_id, pos, {_RGB[0]} r, {_RGB[1]} g, {_RGB[2]} b from smp),
  bn as (select *, least(r // 8, 31) * 1024 + least(g // 8, 31) * 32 + least(b // 8, 31) as bin from rgb),
  md as (select vec_id, arg_min(bin, row(-n, bin)) bin from (select vec_id, bin, count(*) n from bn group by 1, 2) group by 1),
  ce as (select vec_id, median(r) r, median(g) g, median(b) b from bn join md using (vec_id, bin) group by 1),
  nr as (select rgb.*, sqrt(pow(rgb.r - ce.r, 2) + pow(rgb.g - ce.g, 2) + pow(rgb.b - ce.b, 2)) <= 12 as near from rgb join ce using (vec_id)),
  cm as (select vec_id, median(r) filter (near) r, median(g) filter (near) g, median(b) filter (near) b,
    avg(case when near then 1.0 else 0.0 end) support, count(*) used from nr group by 1)"""


@query("a13_colour_mode", f"with {_MODE} select vec_id, r, g, b, round(support, 6) as support, used from cm")
def _a13(t):
    return _colours(t)[1].withColumn("support", F.round("support", 6))


@query("a14_uniformity", f"""with {_MODE}, sp as (select vec_id, support, greatest(abs(rgb.r - cm.r), abs(rgb.g - cm.g), abs(rgb.b - cm.b)) s
    from rgb join cm using (vec_id))
  select vec_id, count(*) as samples, round(quantile_cont(s, 0.95), 6) as p95, round(quantile_cont(s, 0.99), 6) as p99,
    count(*) >= 32 and max(support) >= 0.6 and quantile_cont(s, 0.95) <= 4 and quantile_cont(s, 0.99) <= 10 as uniform from sp group by 1""")
def _a14(t):
    s, colours = _colours(t)
    return samples.uniformity(s, colours, "vec_id").select("vec_id", "samples", *_r("p95", "p99"), "uniform")


_PIX = ["vec_id", "grp", "m > 60 as raw", "m > 110 as confirmed", "pos % 3 = 0 as in_mask", "pos % 3 <> 1 as in_inspection"]
_PIX2 = ["vec_id", "grp", "m > 60 as raw", "m > 110 + grp % 3 * 60 as confirmed", "pos % 3 = 0 as in_mask", "pos % 3 <> 1 as in_inspection"]
_COUNT = """count(*) filter (confirmed and in_mask) as inside, count(*) filter (confirmed and in_inspection and not in_mask) as outside,
   count(*) filter (raw and in_inspection and not confirmed) as uncertain"""


@query("a16_residual_counts", f"""with {_SAMPLES}, px as (select {', '.join(_PIX)} from smp),
  n as (select vec_id, {_COUNT} from px group by 1)
  select *, case when inside > 0 or outside > 0 then 'residual' when uncertain > 0 then 'uncertain' else 'passed' end as status from n""")
def _a16(t):
    return samples.residual_counts(_samples(t).selectExpr(*_PIX), "vec_id")


@query("a17_retry_accept", f"""
  with {_SAMPLES}, p1 as (select {', '.join(_PIX)} from smp), p2 as (select {', '.join(_PIX2)} from smp),
  a as (select grp, vec_id, {_COUNT} from p1 group by 1, 2), b as (select grp, vec_id, {_COUNT} from p2 group by 1, 2),
  j as (select grp, cast(sum(a.inside) as bigint) as initial, cast(sum(b.inside) as bigint) as final,
     bool_or(b.inside > a.inside or b.outside > a.outside) as regressed from a join b using (grp, vec_id) group by 1)
  select grp, initial, final, regressed, initial - final >= greatest(3, ceil(initial * 0.2)) and not regressed and grp % 5 <> 0 as accepted from j""")
def _a17(t):
    s = _samples(t)
    count = lambda cols: (samples.residual_counts(s.selectExpr(*cols), "vec_id").drop("uncertain")
                          .withColumn("uncertain", F.lit(0)).join(t.raw("embeddings").select("vec_id", _c("label").alias("grp")), "vec_id"))
    damage = t.raw("embeddings").select(_c("label").alias("grp")).distinct().withColumn("damaged", _c("grp") % 5 == 0)
    return samples.retry_accept(count(_PIX), count(_PIX2), "grp", "vec_id", damage).select(
        "grp", "initial", "final", "regressed", "accepted")


@query("a18_assemble_chunks", """
  with e as (select image_id, count(*) + case when image_id % 3 = 0 then 1 else 0 end as expected from page_texts group by image_id),
  g as (select image_id as region_id, count(*) as chunks, min(cast(reading_order % 7 as double)) as confidence,
    string_agg(text, '' order by reading_order) as text,
    coalesce(string_agg(cast(reading_order as varchar), ',' order by reading_order) filter (trim(text) = ''), '') as blank
    from page_texts group by 1)
  select region_id, chunks, confidence, md5(text) as digest, blank from g join e on g.region_id = e.image_id where chunks = expected""")
def _a18(t):
    chunks = t.page_texts.selectExpr("image_id as region_id", "reading_order as chunk_index", "text", "cast(reading_order % 7 as double) as confidence")
    expected = t.page_texts.groupBy(_c("image_id").alias("region_id")).agg(
        (F.count(F.lit(1)) + F.when(F.first("image_id") % 3 == 0, 1).otherwise(0)).alias("expected"))
    return telemetry.assemble_chunks(chunks, expected).select(
        "region_id", "chunks", "confidence", F.md5("text").alias("digest"),
        F.array_join(F.transform("empty_chunks", lambda c: c.cast("string")), ",").alias("blank"))


_LUM = ["vec_id", "(m % 250) / 250.0 as luminance", "m % 3 = 0 as ink", "pos < 8 or pos >= 56 as border"]


def _luminance(t):
    return _samples(t).selectExpr(*_LUM).withColumn("luminance", _c("luminance").cast("double"))


@query("a19_ink_polarity", f"""
  with {_SAMPLES}, lm as (select {', '.join(_LUM)} from smp),
  q as (select vec_id, coalesce(median(luminance) filter (border and not ink), median(luminance) filter (not ink), median(luminance)) base,
    count(*) filter (ink) n, count(*) a, quantile_cont(luminance, 0.15) filter (ink) lo, quantile_cont(luminance, 0.85) filter (ink) hi
    from lm group by 1),
  f as (select *, case when abs(lo - base) > abs(hi - base) then lo else hi end far from q)
  select vec_id, round(base, 6) as base, n as ink_pixels, case when n >= 8 and n < 0.8 * a and abs(far - base) >= 0.12
    then case when far < base then '#000000' else '#ffffff' end end as fill from f""")
def _a19(t):
    return samples.ink_polarity(_luminance(t), "vec_id").select("vec_id", *_r("base"), "ink_pixels", "fill")


@query("a20_contrast_choice", f"""
  with {_SAMPLES}, lm as (select {', '.join(_LUM)}, (luminance + 0.05) / 0.05 as cb, 1.05 / (luminance + 0.05) as cw from smp),
  q as (select vec_id, median(luminance) med, quantile_cont(cb, 0.2) b20, quantile_cont(cb, 0.5) b50, quantile_cont(cw, 0.2) w20,
     quantile_cont(cw, 0.5) w50, avg(case when luminance < 0.12 then 1.0 else 0.0 end) >= 0.15
       and avg(case when luminance > 0.5 then 1.0 else 0.0 end) >= 0.15 as mixed from lm group by 1),
  h as (select *, case vec_id % 3 when 0 then '#000000' when 1 then '#ffffff' end as hint, 10 + vec_id % 40 as font_size from q),
  f as (select *, case when hint = '#000000' and b20 >= 4.5 then hint when hint = '#ffffff' and w20 >= 4.5 then hint
      when 1.05 / (med + 0.05) > (med + 0.05) / 0.05 then '#ffffff' else '#000000' end as fill from h)
  select vec_id, fill, round(med, 4) as median, round(case fill when '#000000' then b50 else w50 end, 3) as contrast,
    case when mixed or case fill when '#000000' then b20 else w20 end < 4.5
      then cast(greatest(1, least(3, round_even(font_size * 0.06, 0))) as bigint) else 0 end as stroke_width from f""")
def _a20(t):
    hints = t.raw("embeddings").selectExpr("vec_id", "case vec_id % 3 when 0 then '#000000' when 1 then '#ffffff' end as hint",
                                           "10 + vec_id % 40 as font_size")
    return samples.contrast_choice(_luminance(t), hints, "vec_id")


@query("a21_projection_score", """
  with p as (select image_id, case when locked then y * cos(radians(15.0)) - x * sin(radians(15.0)) else x * cos(radians(15.0)) + y * sin(radians(15.0)) end t, locked
    from text_regions),
  b as (select image_id, locked, floor(t) bin, 1 - (t - floor(t)) w, 1 one from p union all select image_id, locked, floor(t) + 1, t - floor(t), 0 from p),
  h as (select image_id, locked, bin, sum(w) h, sum(one) n from b group by 1, 2, 3)
  select image_id, locked, cast(sum(n) as bigint) as points, round(sum(h * h) / sum(n), 6) as score from h group by 1, 2""")
def _a21(t):
    pts = t.text_regions.select("image_id", "locked", _c("x").alias("px"), _c("y").alias("py"))
    pts = pts.withColumn("t", samples.tilted(F.lit(15.0), ~_c("locked")))
    return samples.projection_score(pts, ["image_id", "locked"]).select("image_id", "locked", "points", *_r("score"))


@query("a23_next_attempt", f"select workflow_id, stage, max(attempt) + 1 as next_attempt from ({_CK}) group by 1, 2")
def _a23(t):
    return telemetry.next_attempt(checkpoints(t))


@query("a23_next_region_key", """
  with c as (select image_id, count(*) + 1 f from text_regions group by 1), u as (select distinct image_id, reading_order n from text_regions),
  x as (select u.image_id, n + 1 n from u join c using (image_id) where n >= f union all select image_id, f from c)
  select image_id, concat('R', lpad(cast(min(n) as varchar), 3, '0')) as next_key from x where (image_id, n) not in (select image_id, n from u) group by 1""")
def _a23b(t):
    return telemetry.next_region_key(t.text_regions.select("image_id", F.format_string("R%03d", "reading_order").alias("region_key")))


@query("a24_review_latency", """select worker, count(*) as reviews,
  round(avg(greatest(0.0, (reviewed_us - claimed_us) / 1e6)), 3) as mean_seconds, max(greatest(0.0, (reviewed_us - claimed_us) / 1e6)) as max_seconds
  from review_pages where outcome is not null group by 1""")
def _a24(t):
    return telemetry.review_latency(t.review_pages)


@query("a25_queue_seconds", "select task_id, greatest(0.0, (updated_us + (task_id % 100 - 20) * 1000000 - updated_us) / 1e6) as queue_seconds from processing_tasks")
def _a25(t):
    return telemetry.queue_seconds(t.processing_tasks.withColumn(
        "started_us", _c("updated_us") + (_c("task_id") % 100 - 20) * 1000000)).select("task_id", "queue_seconds")


@query("a26_storage_reclaimed", f"select project_id, count(*) as files, cast(sum(bytes) as bigint) as bytes from ({_ORPHANS}) group by 1")
def _a26(t):
    return telemetry.storage_reclaimed(orphans(t))


@query("a27_change_token", """
  with d as (select user_id, count(*) n from events_log where k % 3 = 0 group by 1), u as (select user_id, max(ts_us) m from events_log group by 1)
  select u.user_id as project_id, concat(coalesce(n, 0), ':', m) as token from u left join d using (user_id)""")
def _a27(t):
    e = t.events_log
    ops = e.selectExpr("user_id as project_id", "if(k % 3 = 0, 'COMPLETED', 'UNKNOWN') as status")
    return telemetry.change_token(ops, e.selectExpr("user_id as project_id", "ts_us as updated_us"))


_STAGE = "case event_type when 'click' then 'translation' when 'view' then 'mask' when 'error' then 'inpainting' else 'ocr' end"
_CKS = ["user_id * 20 + k % 20 as workflow_id", f"{_STAGE} as stage", "case when event_id % 4 < 2 then 'SUCCEEDED' else 'UNKNOWN' end as status"]


@query("a28_unknown_cloud", f"""
  with c as (select {', '.join(_CKS)} from events_log),
  g as (select workflow_id, count(*) filter (status = 'UNKNOWN') n, bool_or(status = 'SUCCEEDED' and stage = 'translation') t,
    bool_or(status = 'SUCCEEDED' and stage = 'mask') and bool_or(status = 'SUCCEEDED' and stage = 'inpainting') r from c group by 1)
  select workflow_id, n as unknown, concat_ws(',', case when t then 'translation' end, case when r then 'repair' end) as saved from g""")
def _a28(t):
    return telemetry.unknown_cloud(t.events_log.selectExpr(*_CKS))


@query("a30_detection_report", """select image_id, count(*) filter (label = 'text') as text_regions,
  count(*) filter (label = 'onomatopoeia') as excluded_sfx, count(*) filter (label = 'text' and bubble_id is not null) as associated_text_regions,
  count(distinct bubble_id) filter (label = 'text') as associated_bubbles from text_regions group by 1""")
def _a30(t):
    return telemetry.detection_report(t.text_regions)


_PREVIEW = ["grp", "pos % 3 = 0 as in_mask", "m % 256 as before", "case when pos % 3 = 0 and m % 2 = 0 then 255 else m % 256 - m % 5 end as after"]
_PBOX = ["grp", "case when gpos % 2 = 0 then 'before' else 'after' end as moment", "m % 100 as area", "m % 30 as overlap"]


@query("a31_removal_eval", f"""
  with {_SAMPLES}, p as (select {', '.join(_PREVIEW)} from smp), b as (select {', '.join(_PBOX)} from smp),
  n as (select grp, count(*) filter (in_mask) as mask_pixels, count(*) filter (in_mask and before < 128) as dark_before,
    count(*) filter (in_mask and after < 128) as dark_after, count(*) filter (not in_mask and before <> after) as changed_outside,
    coalesce(max(abs(after - before)) filter (not in_mask), 0) as max_delta_outside from p group by 1),
  o as (select grp, count(*) filter (area > 0 and overlap >= 0.2 * area and moment = 'before') boxes_before,
    count(*) filter (area > 0 and overlap >= 0.2 * area and moment = 'after') boxes_after from b group by 1)
  select n.*, coalesce(boxes_before, 0) as boxes_before, coalesce(boxes_after, 0) as boxes_after,
    round(1 - dark_after * 1.0 / greatest(1, dark_before), 4) as reduction from n left join o using (grp)""")
def _a31(t):
    s = _samples(t)
    return samples.removal_eval(s.selectExpr(*_PREVIEW), s.selectExpr(*_PBOX), "grp")
