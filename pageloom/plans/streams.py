"""K-01..K-10: batch twins bound to the given tables (the streams themselves run in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.plans.registry import query
from pageloom.streaming import jobs as J

_c = F.col
_TASK = ["user_id * 10 + k % 10 as task_id", "event_id", "case when k > 95 then 'COMPLETED' when k % 3 = 0 then 'RUNNING' else 'QUEUED' end as status",
         "k % 2 as progress", "event_type as stage", "'' as message"]


@query("k01_status_changes", f"""
  with t as (select {', '.join(_TASK)} from events_log), s as (select *, concat_ws('|', status, progress, stage, message) g from t),
  e as (select task_id, min(event_id) e from s where status = 'COMPLETED' group by 1),
  l as (select s.*, lag(g) over (partition by s.task_id order by event_id) p from s left join e using (task_id) where e is null or event_id <= e)
  select task_id, event_id, status from l where g is distinct from p""")
def _k01(t):
    return J.status_changes_batch(t.events_log.selectExpr(*_TASK), F.floor(_c("event_id") / 4096))


def _samples(t):
    ts = F.expr("timestamp_micros(ts_us)")
    return t.events_log.select(_c("event_type").alias("kind"), ts.alias("ts"), _c("seconds").alias("elapsed"), (_c("k") / 10.0).cast("double").alias("units"))


def _us(name):
    return F.unix_micros(name).alias(name)


@query("k02_stage_latency", """
  with s as (select event_type kind, ts_us - ts_us % 3600000000 as ws, greatest(0.1, k / 10.0) u, greatest(0.001, seconds) / greatest(0.1, k / 10.0) l from events_log)
  select kind, ws as window_start, count(*) as samples, round(sum(u), 6) as units, round((list_sort(list(l)))[cast(ceil(count(*) * 0.95) as bigint)], 6) as p95,
    count(*) >= 8 as ready from s group by 1, 2""")
def _k02(t):
    out = J.stage_latency(_samples(t), "1 hour", None)
    return out.select("kind", _us("window_start"), "samples", F.round("units", 6).alias("units"), F.round("p95", 6).alias("p95"), "ready")


@query("k03_rolling_stage", """
  with s as (select event_type kind, seconds, unnest([ts_us - ts_us % 1800000000, ts_us - ts_us % 1800000000 - 1800000000]) as ws from events_log)
  select kind, ws as window_start, count(*) as samples, round(avg(seconds), 6) as mean_seconds from s group by 1, 2""")
def _k03(t):
    return J.rolling_stage(_samples(t), "1 hour", "30 minutes", None).select(
        "kind", _us("window_start"), "samples", F.round("mean_seconds", 6).alias("mean_seconds"))


_OPS = ["concat(user_id, '-', event_type, '-', k % 9) as operation_id", "event_id", "concat('f', k % 2) as fingerprint"]


@query("k04_idempotent_ops", f"""
  with o as (select {', '.join(_OPS)} from events_log), f as (select operation_id, min(event_id) i, arg_min(fingerprint, event_id) p from o group by 1)
  select operation_id, event_id, case when event_id = i then 'first' when fingerprint = p then 'replay' else 'conflict' end as verdict from o join f using (operation_id)""")
def _k04(t):
    return J.idempotent_ops_batch(t.events_log.selectExpr(*_OPS))


_RES = ["user_id as task_id", "event_id", "event_id % 6 + event_id // 2000 as generation",
        "case k % 3 when 0 then 'RUNNING' when 1 then 'PAUSED' else 'FAILED' end as task_status", "k % 2 = 0 as succeeded"]


@query("k05_fence_late", f"""
  with r as (select {', '.join(_RES)} from events_log), m as (select *, max(generation) over (partition by task_id order by event_id) mx from r)
  select task_id, event_id from m where generation = mx and (task_status = 'RUNNING' or (task_status = 'PAUSED' and succeeded))""")
def _k05(t):
    return J.fence_late_batch(t.events_log.selectExpr(*[e.replace("//", "div") for e in _RES]))


@query("k07_recover_interrupted", """select task_id, case status when 'RUNNING' then 'FAILED' when 'CANCELLING' then 'CANCELLED' else status end as status,
  case status when 'RUNNING' then 'interrupted' end as error, case status when 'QUEUED' then created_us end as requeue_at from processing_tasks""")
def _k07(t):
    return J.recover_interrupted(t.processing_tasks).select("task_id", "status", "error", _c("requeue_key.created_us").alias("requeue_at"))


@query("k07_recover_checkpoints", """select event_id, event_type as stage, case when event_id % 4 = 1 then case when event_type in ('ocr', 'translation') then 'UNKNOWN' else 'INTERRUPTED' end
  else 'SUCCEEDED' end as status from (select event_id, event_id % 4, case event_type when 'click' then 'ocr' when 'view' then 'translation' else 'mask' end as event_type from events_log)""")
def _k07b(t):
    ck = t.events_log.selectExpr("event_id", "case event_type when 'click' then 'ocr' when 'view' then 'translation' else 'mask' end as stage",
                                 "if(event_id % 4 = 1, 'RUNNING', 'SUCCEEDED') as status")
    return J.recover_checkpoints(ck)


@query("k08_wake_dependents")
def _k08(t):
    ts = F.expr("timestamp_micros(ts_us)")
    e = t.events_log.select("event_id", "event_type", "k", ts.alias("ts"))
    tasks = e.select(_c("event_id").alias("task_id"), (_c("event_id") - 1).alias("dependency_id"), F.lit("QUEUED").alias("status"), "ts")
    cks = e.select(_c("event_id").alias("task_id"), F.when(_c("event_type") == "click", "translation").otherwise("ocr").alias("stage"),
                   F.when(_c("k") % 2 == 0, "SUCCEEDED").otherwise("FAILED").alias("status"), "ts")
    return J.wake_dependents(tasks, cks, None)


@query("k09_lease_sessions", """
  with c as (select user_id, ts_us, lag(ts_us) over (partition by user_id order by ts_us) p from events_log),
  s as (select *, sum(case when p is null or ts_us - p >= 10800000000 then 1 else 0 end) over (partition by user_id order by ts_us) n from c)
  select user_id as worker_id, min(ts_us) as started, max(ts_us) + 10800000000 as ends, count(*) as claims from s group by user_id, n""")
def _k09(t):
    claims = t.events_log.select(_c("user_id").alias("worker_id"), F.expr("timestamp_micros(ts_us)").alias("ts"))
    return J.lease_sessions(claims, "3 hours", None).select("worker_id", _us("started"), _us("ends"), "claims")


_CLAIM = ["user_id as workflow_id", "event_type as stage", "event_id", "k % 4 as input_fingerprint",
          "case event_id % 5 when 0 then 'SUCCEEDED' when 1 then 'UNKNOWN' when 2 then 'RUNNING' else 'FAILED' end as status"]


@query("k10_checkpoint_reuse", f"""
  with c as (select {', '.join(_CLAIM)} from events_log),
  s as (select workflow_id, stage, input_fingerprint, min(event_id) a, arg_min(status, event_id) h from c where status <> 'FAILED' group by 1, 2, 3),
  m as (select c.*, h, case when a is null or event_id <= a then 1 else 0 end o from c left join s using (workflow_id, stage, input_fingerprint)),
  n as (select *, sum(o) over (partition by workflow_id, stage order by event_id) i from m)
  select workflow_id, stage, event_id, case when o = 1 then concat('attempt ', i) when h = 'UNKNOWN' then 'ask' when h = 'SUCCEEDED' then 'reuse' else 'busy' end as decision from n""")
def _k10(t):
    return J.checkpoint_reuse_batch(t.events_log.selectExpr(*_CLAIM))


@query("k06_assemble_chunks", """
  with g as (select image_id as region_id, count(*) as chunks, string_agg(text, '' order by reading_order) as x from page_texts group by 1)
  select region_id, chunks, md5(x) as digest from g""")
def _k06(t):
    from pageloom.operators.telemetry import assemble_chunks
    chunks = t.page_texts.selectExpr("image_id as region_id", "reading_order as chunk_index", "text", "cast(1 as double) as confidence")
    expected = t.page_texts.groupBy(_c("image_id").alias("region_id")).agg(F.count(F.lit(1)).alias("expected"))
    return assemble_chunks(chunks, expected).select("region_id", "chunks", F.md5("text").alias("digest"))
