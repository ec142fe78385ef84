"""Checkpoints, dependencies, deltas, merges, assets and version fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core import ranking
from pageloom.functions import text as X

_c = F.col
KEY = ["image_id", "region_id"]


def latest_successful(checkpoints: DataFrame) -> DataFrame:
    """The last successful attempt per workflow, stage and input."""
    keys = ["workflow_id", "stage", "input_fingerprint"]
    return checkpoints.where("status = 'SUCCEEDED'").groupBy(*keys).agg(
        F.max("attempt").alias("attempt"), F.max_by("checkpoint_id", "attempt").alias("checkpoint_id"))


def previous_page(pages: DataFrame) -> DataFrame:
    """Each page with the nearest lower page of its project."""
    return ranking.previous_row(pages, ["project_id"], ["order_index", "image_id"],
                                F.floor(_c("order_index") / 4096), ["image_id"], "previous_")


def dependency_state(tasks: DataFrame, checkpoints: DataFrame, parallel_repair: bool = True) -> DataFrame:
    """ready / waiting / repair / failed / stopped for every task."""
    done = checkpoints.where("status = 'SUCCEEDED'").groupBy("task_id", "generation").agg(
        F.bool_or(_c("stage") == "translation").alias("has_translation"),
        F.bool_or(_c("stage") == "ocr").alias("has_ocr"),
        F.bool_or(_c("stage") == "inpainting").alias("has_repair"))
    before = tasks.join(done.select("task_id", "generation", "has_translation"), ["task_id", "generation"], "left").select(
        _c("task_id").alias("dependency_id"), _c("status").alias("_pstatus"), _c("batch_id").alias("_pbatch"),
        F.coalesce("has_translation", F.lit(False)).alias("_ptranslated"))
    own = tasks.join(done.drop("has_translation"), ["task_id", "generation"], "left")
    no = lambda n: ~F.coalesce(n, F.lit(False))
    state = (F.when((_c("status") != "QUEUED") | _c("pause_requested"), "stopped")
             .when(_c("dependency_id").isNull() | _c("has_context"), "ready")
             .when(_c("_pstatus").isNull() | (_c("_pbatch") != _c("batch_id")), "failed")
             .when(_c("_ptranslated"), "ready")
             .when(_c("_pstatus").isin("FAILED", "CANCELLED", "COMPLETED"), "failed")
             .when(_c("end_stage") == "translation", F.when(no("has_ocr"), "repair").otherwise("waiting"))
             .when(_c("repairs_source") & F.lit(parallel_repair) & no("has_repair"), "repair")
             .otherwise("waiting"))
    return own.join(before, "dependency_id", "left").select("task_id", "dependency_id", state.alias("state"))


def _long(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    picked = df.select(*KEY, *[_c(c).cast("string").alias(c) for c in columns])
    return picked.unpivot(KEY, list(columns), "field", name)


def delta(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(keys, op, field, value): changed fields, whole new rows, deleted keys."""
    old = before.select(*KEY, F.lit(True).alias("_old"), *[_c(c).cast("string").alias(f"_o_{c}") for c in columns])
    new = after.select(*KEY, F.lit(True).alias("_new"), *[_c(c).cast("string").alias(c) for c in columns])
    both = old.join(new, KEY, "full")
    changes = [F.when(_c("_new") & (_c("_old").isNull() | ~_c(c).eqNullSafe(_c(f"_o_{c}"))),
                      F.struct(F.lit("put").alias("op"), F.lit(c).alias("field"), _c(c).alias("value")))
               for c in columns]
    gone = F.when(_c("_new").isNull(), F.struct(
        F.lit("delete").alias("op"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
    return both.select(*KEY, F.explode(F.array_compact(F.array(gone, *changes))).alias("_d")).select(*KEY, "_d.*")


def apply_delta(state: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop deleted rows, overwrite changed fields, add new rows."""
    types = dict(state.dtypes)
    wide = changes.where("op = 'put'").groupBy(*KEY).agg(
        F.lit(True).alias("_put"),
        *[F.bool_or(_c("field") == c).alias(f"_set_{c}") for c in columns],
        *[F.max(F.when(_c("field") == c, _c("value"))).alias(f"_v_{c}") for c in columns])
    kept = state.select(*KEY, *columns).join(changes.where("op = 'delete'").select(*KEY), KEY, "left_anti")
    return kept.join(wide, KEY, "full").select(*KEY, *[
        F.when(_c(f"_set_{c}"), _c(f"_v_{c}").cast(types[c])).otherwise(_c(c)).alias(c) for c in columns])


def merge3(base: DataFrame, left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(keys, field, value, conflict): three-way merge of flattened rows.

    A row deleted on one side and edited on the other is one conflict on the
    whole row (null field).
    """
    sides = [df.select(*KEY, F.lit(True).alias(f"_{n}"), *[_c(c).cast("string").alias(f"{n}_{c}") for c in columns])
             for df, n in ((base, "b"), (left, "l"), (right, "r"))]
    rows = sides[0].join(sides[1], KEY, "full").join(sides[2], KEY, "full")
    here = {n: F.coalesce(f"_{n}", F.lit(False)) for n in "blr"}
    cell = {(n, c): F.when(here[n], F.struct(_c(f"{n}_{c}").alias("v"))) for n in "blr" for c in columns}

    def edited(n: str) -> Column:
        changed = F.lit(False)
        for c in columns:
            changed = changed | ~cell[n, c].eqNullSafe(cell["b", c])
        return changed
    torn = here["b"] & ((~here["l"] & here["r"] & edited("r")) | (~here["r"] & here["l"] & edited("l")))
    gone = here["b"] & (~here["l"] | ~here["r"]) & ~torn
    text, bool_ = F.lit(None).cast("string"), F.lit(True)
    out = [F.when(torn, F.struct(text.alias("field"), text.alias("value"), bool_.alias("conflict")))]
    for c in columns:
        b, a, r = cell["b", c], cell["l", c], cell["r", c]
        clash = ~a.eqNullSafe(r) & ~a.eqNullSafe(b) & ~r.eqNullSafe(b)
        # A side that lacks the row lacks every cell; only added rows get here that way.
        value = F.when(a.eqNullSafe(b), r).otherwise(a)
        clash = clash & a.isNotNull() & r.isNotNull()
        value = F.when(a.isNull(), r).when(r.isNull(), a).otherwise(value)
        out.append(F.when(~torn & ~gone, F.struct(
            F.lit(c).alias("field"), F.when(~clash, value["v"]).alias("value"), clash.alias("conflict"))))
    return rows.select(*KEY, F.explode(F.array_compact(F.array(*out))).alias("_m")).select(*KEY, "_m.*")


def validate_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A checkpoint stays valid only when every file exists with equal bytes and hash."""
    seen = files.select("path", _c("bytes").alias("_bytes"), _c("sha").alias("_sha"))
    same = (_c("bytes") == _c("_bytes")) & (_c("sha") == _c("_sha"))
    return manifest.join(seen, "path", "left").groupBy("checkpoint_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.coalesce(same, F.lit(False))).alias("bad")).withColumn(
        "status", F.when(_c("bad") > 0, "INVALID").otherwise("SUCCEEDED"))


def orphan_assets(files: DataFrame, references: DataFrame, grace_minutes: int, protected: DataFrame | None = None,
                  cap: int | None = None) -> DataFrame:
    """Old files nothing refers to; ``cap`` bounds one collection run per project.

    ``protected`` directories keep everything below them, at any depth.
    """
    out = (files.where(_c("age_minutes") >= grace_minutes)
           .join(references.select("path").distinct(), "path", "left_anti"))
    if protected is not None:
        # a path lies in as many folders as it has slashes: those meet the protected ones
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        safe = (out.select("path", F.explode(above).alias("directory")).where(_c("directory") != _c("path"))
                .join(protected.select("directory"), "directory", "left_semi").select("path").distinct())
        out = out.join(safe, "path", "left_anti")
    if cap is not None:
        turn = Window.partitionBy("project_id").orderBy("path")
        out = out.withColumn("_n", F.row_number().over(turn)).where(_c("_n") <= cap).drop("_n")
    return out


def reconcile_ids(requested: DataFrame, received: DataFrame) -> DataFrame:
    """ok / missing / blank / extra / duplicate for every id on either side."""
    got = received.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(X.has_text(_c("text"))).alias("_said"))
    want = requested.select(*KEY, F.lit(True).alias("_want"))
    verdict = (F.when(_c("_want").isNull(), "extra").when(_c("_n").isNull(), "missing").when(_c("_n") > 1, "duplicate")
               .when(~_c("_said"), "blank").otherwise("ok"))
    return want.join(got, KEY, "full").select(*KEY, verdict.alias("status"))


def resolve_regions(references: DataFrame, regions: DataFrame) -> DataFrame:
    """Per page: resolved, unknown and doubled references by id or by key."""
    by_id = regions.select("image_id", _c("region_id").cast("string").alias("ref"), "region_id")
    by_key = regions.select("image_id", _c("region_key").alias("ref"), "region_id")
    found = references.join(by_id.union(by_key), ["image_id", "ref"], "left")
    per_region = found.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("_n"))
    known = _c("region_id").isNotNull()
    return per_region.groupBy("image_id").agg(
        F.count_if(known).alias("resolved"),
        F.coalesce(F.sum(F.when(~known, _c("_n"))), F.lit(0)).alias("unknown"),
        F.count_if(known & (_c("_n") > 1)).alias("doubled")).withColumn(
        "ok", (_c("unknown") == 0) & (_c("doubled") == 0))


def stale_reviews(reviews: DataFrame) -> DataFrame:
    status = (F.when(_c("outcome").isNull(), "pending")
              .when(_c("reviewed_version") != _c("current_version"), "stale").otherwise(_c("outcome")))
    return reviews.withColumn("review_status", status)


def page_owners(reviews: DataFrame, now_us: int) -> DataFrame:
    """(run, page) of every run that some page keeps active."""
    open_ = ((_c("lease_expires_us") > now_us) | _c("correction_open") | _c("outcome").isNull()
             | (_c("reviewed_version") != _c("current_version"))
             | ((_c("outcome") == "issues") & ~_c("deliver_with_issues")))
    active = reviews.groupBy("run_id").agg(F.bool_or(open_).alias("_active")).where("_active").select("run_id")
    return reviews.select("run_id", "image_id").join(active, "run_id", "left_semi")


def version_guard(updates: DataFrame, rows: DataFrame, batch: Sequence[str] | None) -> DataFrame:
    """Updates whose captured version is still stored; by whole batch when ``batch`` is given."""
    now = rows.select(*KEY, _c("version").alias("_stored"))
    checked = updates.join(now, KEY, "left").withColumn("applied", F.coalesce(_c("version") == _c("_stored"), F.lit(False)))
    if batch:
        whole = checked.groupBy(*batch).agg(F.bool_and("applied").alias("_all"))
        checked = checked.join(whole, list(batch)).withColumn("applied", _c("_all")).drop("_all")
    return checked.drop("_stored")


def configuration_drift(runs: DataFrame, projects: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(run_id, field) for each frozen field that no longer equals the project's."""
    now = projects.select("project_id", *[_c(f).alias(f"_now_{f}") for f in fields])
    changed = [F.when(~_c(f).eqNullSafe(_c(f"_now_{f}")), F.lit(f)) for f in fields]
    return runs.join(now, "project_id").select("run_id", F.explode(F.array_compact(F.array(*changed))).alias("field"))


def recover_operation(operations: DataFrame, manifest: DataFrame, tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Settle UNKNOWN operations from receipts, admitted tasks or tagged work."""
    known = tasks.select("task_id", F.lit(True).alias("_exists"))
    admitted = manifest.join(known, "task_id", "left").groupBy("operation_id").agg(
        F.bool_and(_c("_exists").isNotNull()).alias("_all_tasks"))
    by_task = tasks.where("operation_id is not null").select("operation_id").distinct().withColumn("_task", F.lit(True))
    by_job = jobs.select("operation_id").distinct().withColumn("_job", F.lit(True))
    lease = (_c("tool") == "workflow_advance") & _c("action").isin("claim", "renew", "release", "accept_configuration")
    outcome = (F.when(_c("status") != "UNKNOWN", "settled")
               .when(_c("has_receipt"), "receipt")
               .when(lease, "not_applied")
               .when((_c("tool") == "workflow_advance") & _c("_all_tasks"), "tasks_admitted")
               .when(_c("tool").isin("workflow_advance", "task_retry") & _c("_all_tasks").isNull() & _c("_task"), "task_found")
               .when(_c("tool").isin("project_import", "workflow_export") & _c("_job"), "job_found")
               .otherwise("unknown"))
    return (operations.join(admitted, "operation_id", "left").join(by_task, "operation_id", "left")
            .join(by_job, "operation_id", "left")
            .select("operation_id", outcome.alias("outcome"),
                    F.when(_c("outcome") == "unknown", "UNKNOWN").otherwise(
                        F.when(_c("status") == "UNKNOWN", "COMPLETED").otherwise(_c("status"))).alias("status")))


def select_model(requests: DataFrame, models: DataFrame, cloud_providers: Sequence[str]) -> DataFrame:
    """The newest enabled model of each kind that matches the request or is default.

    A request overrides the default only at the stage the work starts from.
    """
    asked = F.when(_c("stage") == _c("start_stage"), _c("requested"))
    usable = models.where("enabled")

    def newest(keys: list[str]) -> DataFrame:
        return usable.groupBy(*keys).agg(F.max_by(F.struct("model_id", "provider", "name", "updated"),
                                                  F.struct("updated", "model_id")).alias("_n"))

    # at most one candidate per (kind, provider), (kind, name) and kind meets each request
    by_provider = newest(["kind", "provider"]).select("kind", _c("provider").alias("_asked"), _c("_n").alias("_p"))
    by_name = newest(["kind", "name"]).select("kind", _c("name").alias("_asked"), _c("_n").alias("_q"))
    usual = usable.where("is_default").groupBy("kind").agg(
        F.max_by(F.struct("model_id", "provider", "name", "updated"), F.struct("updated", "model_id")).alias("_d"))
    keyed = requests.withColumn("_asked", asked)
    found = (keyed.join(by_provider, ["kind", "_asked"], "left").join(by_name, ["kind", "_asked"], "left").join(usual, "kind", "left"))
    age = lambda m: F.struct(_c(m)["updated"].alias("updated"), _c(m)["model_id"].alias("model_id"))
    better = F.when(_c("_p").isNull() | (age("_q") > age("_p")), F.coalesce("_q", "_p")).otherwise(_c("_p"))
    chosen = found.withColumn("_m", F.when(asked.isNull(), _c("_d")).otherwise(better))
    return chosen.select("request_id", "kind", _c("_m.model_id").alias("model_id"),
                         F.coalesce(_c("_m.provider"), asked).isin(*cloud_providers).alias("cloud"))
