"""Structured Streaming jobs over the state tables, each with a batch twin.

A stream function takes a streaming DataFrame and returns one; the twin gives
the same rows for a finished table.  Event time is ``ts`` (timestamp) and the
watermark is ten minutes unless given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pageloom.core import ranking

_c = F.col
WATERMARK = "10 minutes"
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
CLOUD_STAGES = ("ocr", "translation")


def _stateful(df: DataFrame, keys: list[str], out: str, state: str, step: Callable[[tuple, tuple], tuple[tuple, Iterable[tuple]]],
              start: tuple, order: str) -> DataFrame:
    """Fold each micro-batch's rows of a key, in ``order``, into a small state tuple."""
    names = [f.strip().split(" ")[0] for f in out.split(",")]

    def run(key, batches, store):
        held = store.get if store.exists else start
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.sort_values(order).itertuples(index=False):
                held, made = step(held, row)
                rows.extend(made)
        store.update(held)
        yield pd.DataFrame(rows, columns=names)
    return df.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


# K-01 ---------------------------------------------------------------------
def status_changes(tasks: DataFrame) -> DataFrame:
    """Rows whose visible status differs from the last one shown; nothing after a terminal status."""
    def step(held, row):
        seen, over = held
        if over or seen == row.signature:
            return held, ()
        return (row.signature, row.status in TERMINAL), [(row.task_id, row.event_id, row.status)]
    signed = tasks.withColumn("signature", F.concat_ws("|", "status", "progress", "stage", "message"))
    return _stateful(signed, ["task_id"], "task_id bigint, event_id bigint, status string", "seen string, over boolean", step, (None, False), "event_id")


def status_changes_batch(tasks: DataFrame, bucket: Column) -> DataFrame:
    signed = tasks.withColumn("signature", F.concat_ws("|", "status", "progress", "stage", "message"))
    over = signed.where(_c("status").isin(*TERMINAL)).groupBy("task_id").agg(F.min("event_id").alias("_end"))
    live = signed.join(over, "task_id", "left").where(_c("_end").isNull() | (_c("event_id") <= _c("_end")))
    return ranking.previous_row(live, ["task_id"], ["event_id"], bucket, ["signature"], "was_").where(
        ~_c("signature").eqNullSafe(_c("was_signature"))).select("task_id", "event_id", "status")


# K-02, K-03 ---------------------------------------------------------------
def stage_latency(samples: DataFrame, size: str = "30 seconds", watermark: str | None = WATERMARK, min_samples: int = 8) -> DataFrame:
    """Throughput and p95 latency per unit, per kind and tumbling window."""
    s = samples.withWatermark("ts", watermark) if watermark else samples
    units = F.greatest(F.lit(0.1), "units")
    s = s.withColumn("_units", units).withColumn("_latency", F.greatest(F.lit(0.001), "elapsed") / units)
    return s.groupBy(F.window("ts", size).alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("_units").alias("units"),
        F.expr("percentile_disc(0.95) within group (order by _latency)").alias("p95")).select(
        "kind", _c("w.start").alias("window_start"), "samples", "units", "p95", (_c("samples") >= min_samples).alias("ready"))


def rolling_stage(samples: DataFrame, size: str = "10 minutes", slide: str = "1 minute", watermark: str | None = WATERMARK) -> DataFrame:
    """Count and mean seconds per stage over a sliding window."""
    s = samples.withWatermark("ts", watermark) if watermark else samples
    return s.groupBy(F.window("ts", size, slide).alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("elapsed").alias("mean_seconds")).select(
        "kind", _c("w.start").alias("window_start"), "samples", "mean_seconds")


# K-04 ---------------------------------------------------------------------
def idempotent_ops(ops: DataFrame) -> DataFrame:
    """first / replay / conflict for each operation, by its id and fingerprint."""
    def step(held, row):
        first = held[0]
        word = "first" if first is None else "replay" if first == row.fingerprint else "conflict"
        return (first or row.fingerprint,), [(row.operation_id, row.event_id, word)]
    return _stateful(ops, ["operation_id"], "operation_id string, event_id bigint, verdict string", "first string", step, (None,), "event_id")


def idempotent_ops_batch(ops: DataFrame) -> DataFrame:
    first = ops.groupBy("operation_id").agg(F.min("event_id").alias("_id"), F.min_by("fingerprint", "event_id").alias("_print"))
    verdict = (F.when(_c("event_id") == _c("_id"), "first").when(_c("fingerprint") == _c("_print"), "replay").otherwise("conflict"))
    return ops.join(first, "operation_id").select("operation_id", "event_id", verdict.alias("verdict"))


# K-05 ---------------------------------------------------------------------
def fence_late(results: DataFrame) -> DataFrame:
    """Results of the newest generation seen so far whose task runs (a success also counts while paused)."""
    def step(held, row):
        newest = max(held[0], row.generation)
        live = row.task_status == "RUNNING" or (row.task_status == "PAUSED" and row.succeeded)
        keep = row.generation == newest and live
        return (newest,), [(row.task_id, row.event_id)] if keep else ()
    return _stateful(results, ["task_id"], "task_id bigint, event_id bigint", "newest bigint", step, (-1,), "event_id")


def fence_late_batch(results: DataFrame) -> DataFrame:
    first = results.groupBy("task_id", "generation").agg(F.min("event_id").alias("_since"))
    after = Window.partitionBy("task_id").orderBy("generation").rowsBetween(1, Window.unboundedFollowing)
    later = first.select("task_id", "generation", F.min("_since").over(after).alias("_until"))
    live = (_c("task_status") == "RUNNING") | ((_c("task_status") == "PAUSED") & _c("succeeded"))
    return results.join(later, ["task_id", "generation"], "left").where(
        live & (_c("_until").isNull() | (_c("event_id") < _c("_until")))).select("task_id", "event_id")


# K-06 ---------------------------------------------------------------------
def assemble_stream(chunks: DataFrame) -> DataFrame:
    """A region's text as soon as all its expected chunks have arrived."""
    def step(held, row):
        parts = {**dict(zip(held[0], held[1])), row.chunk_index: row.text}
        order = sorted(parts)
        done = len(parts) == row.expected and len(held[0]) < row.expected
        text = "".join(parts[i] for i in order)
        return (order, [parts[i] for i in order]), [(row.region_id, len(parts), text)] if done else ()
    return _stateful(chunks, ["region_id"], "region_id bigint, chunks bigint, text string", "at array<bigint>, parts array<string>", step, ([], []), "chunk_index")


# K-07 ---------------------------------------------------------------------
def recover_interrupted(tasks: DataFrame) -> DataFrame:
    """State after a restart: running work failed, cancellations done, queued work in requeue order."""
    status = (F.when(_c("status") == "RUNNING", "FAILED").when(_c("status") == "CANCELLING", "CANCELLED").otherwise(_c("status")))
    return tasks.select("task_id", status.alias("status"), F.when(_c("status") == "RUNNING", "interrupted").alias("error"),
                        F.when(_c("status") == "QUEUED", F.struct("created_us", "task_id")).alias("requeue_key"))


def recover_checkpoints(checkpoints: DataFrame) -> DataFrame:
    lost = F.when(_c("stage").isin(*CLOUD_STAGES), "UNKNOWN").otherwise("INTERRUPTED")
    return checkpoints.withColumn("status", F.when(_c("status") == "RUNNING", lost).otherwise(_c("status")))


# K-08 ---------------------------------------------------------------------
def wake_dependents(tasks: DataFrame, checkpoints: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Waiting tasks whose predecessor's translation has just succeeded."""
    t, c = tasks.where("status = 'QUEUED'"), checkpoints.where("stage = 'translation' and status = 'SUCCEEDED'")
    if watermark:
        t, c = t.withWatermark("ts", watermark), c.withWatermark("ts", watermark)
    done = c.select(_c("task_id").alias("_done"), _c("ts").alias("_at"))
    return t.join(done, (_c("dependency_id") == _c("_done")) & (_c("_at") >= _c("ts") - F.expr("interval 1 day"))
                  & (_c("_at") <= _c("ts") + F.expr("interval 1 day"))).select("task_id", "dependency_id", _c("_at").alias("ready_at"))


# K-09 ---------------------------------------------------------------------
def lease_sessions(claims: DataFrame, lease: str = "15 minutes", watermark: str | None = WATERMARK) -> DataFrame:
    """Continuous ownership: claims of one worker that renew before the lease ends."""
    s = claims.withWatermark("ts", watermark) if watermark else claims
    return s.groupBy(F.session_window("ts", lease).alias("w"), "worker_id").agg(F.count(F.lit(1)).alias("claims")).select(
        "worker_id", _c("w.start").alias("started"), _c("w.end").alias("ends"), "claims")


# K-10 ---------------------------------------------------------------------
def checkpoint_reuse(claims: DataFrame) -> DataFrame:
    """reuse / busy / ask / the next attempt, for each claim of a stage on one input."""
    def step(held, row):
        attempt, success, unknown, running = held
        same = str(row.input_fingerprint)
        if same in unknown:
            word = "ask"
        elif same in success:
            word = "reuse"
        elif same in running:
            word = "busy"
        else:
            attempt, word = attempt + 1, f"attempt {attempt + 1}"
            side = {"SUCCEEDED": success, "UNKNOWN": unknown, "RUNNING": running}.get(row.status)
            if side is not None:
                side = side + [same]
            success, unknown, running = (side if row.status == n and side is not None else old for n, old in
                                         (("SUCCEEDED", success), ("UNKNOWN", unknown), ("RUNNING", running)))
        return (attempt, success, unknown, running), [(row.workflow_id, row.stage, row.event_id, word)]
    return _stateful(claims, ["workflow_id", "stage"], "workflow_id bigint, stage string, event_id bigint, decision string",
                     "attempt bigint, success array<string>, unknown array<string>, running array<string>", step, (0, [], [], []), "event_id")


def checkpoint_reuse_batch(claims: DataFrame) -> DataFrame:
    """Same decisions on a table: an input is settled by its first non-failed claim, failures only count attempts."""
    key = ["workflow_id", "stage"]
    settled = claims.where("status <> 'FAILED'").groupBy(*key, "input_fingerprint").agg(
        F.min("event_id").alias("_at"), F.min_by("status", "event_id").alias("_how"))
    marked = claims.join(settled, [*key, "input_fingerprint"], "left").withColumn(
        "_opens", F.when(_c("_at").isNull() | (_c("event_id") <= _c("_at")), 1).otherwise(0))
    numbered = ranking.running_sum(marked, key, [_c("event_id")], F.floor(_c("event_id") / 4096), _c("_opens"), "_earlier")
    word = (F.when(_c("_opens") == 1, F.concat(F.lit("attempt "), (_c("_earlier") + 1).cast("string")))
            .when(_c("_how") == "UNKNOWN", "ask").when(_c("_how") == "SUCCEEDED", "reuse").otherwise("busy"))
    return numbered.select(*key, "event_id", word.alias("decision"))
