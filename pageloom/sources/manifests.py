"""Portable manifests, delivery listings and review reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core import ranking
from pageloom.sources.schemas import PAGE_JSON

_c = F.col
SCHEMA_VERSION = 2
TEXT_KEYS = ("source_text", "translated_text", "text", "prompt", "raw_response")


def export_manifest(projects: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(project_id, order_index, manifest): one JSON document per page, its regions nested.

    A project is the set of its documents in order_index order, so that no
    project, however large, has to fit in one row.
    """
    box = lambda *n: F.array(*[F.coalesce(*[_c(k) for k in c]).cast("double") for c in n])
    region = F.struct(
        _c("region_key").alias("region_id"), box(("x",), ("y",), ("w",), ("h",)).alias("bbox"),
        box(("tx", "x"), ("ty", "y"), ("tw", "w"), ("th", "h")).alias("translated_bbox"), "source_text", "translated_text",
        "confidence", "orientation", "reading_order", F.struct(_c("font_family").alias("family"), _c("font_size").cast("double").alias("size")).alias("font"))
    nested = regions.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "reading_order", "region_key", region.alias("r")))), lambda v: v["r"]).alias("regions"))
    doc = F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct("name", "description", "source_language", "target_language").alias("project"),
        F.struct(_c("image_id").alias("id"), "order_index", "width", "height").alias("page"), "regions"), {"ignoreNullFields": "false"})
    return (pages.join(projects, "project_id").join(nested, "image_id", "left")
            .select("project_id", "order_index", doc.alias("manifest")))


def import_manifest(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, regions, rejected) from manifest documents of schema version 1 or 2."""
    from pageloom.functions.text import bounded_text
    # exploded, so that the filters below cannot parse (and, of a computed manifest, build) each document again
    parsed = documents.withColumn("d", F.explode(F.array(F.from_json("manifest", PAGE_JSON))))
    bad = ~F.coalesce(_c("d.schema_version").isin(1, 2), F.lit(False))
    ok = parsed.where(~bad)
    pages = ok.select(
        "project_id", _c("d.page.id").alias("image_id"), F.coalesce("d.page.order_index", "order_index").alias("order_index"),
        bounded_text(_c("d.project.name"), "Imported project", 200).alias("name"), bounded_text(_c("d.project.description"), "", 2000).alias("description"),
        bounded_text(_c("d.project.source_language"), "ja", 32).alias("source_language"),
        bounded_text(_c("d.project.target_language"), "zh-CN", 32).alias("target_language"))
    rows = ok.select(_c("d.page.id").alias("image_id"), F.posexplode("d.regions").alias("at", "r"))
    regions = rows.select("image_id", "at", bounded_text(_c("r.region_id"), "R", 24).alias("region_key"),
                          *[F.get("r.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")],
                          F.coalesce(F.get("r.translated_bbox", F.lit(0)), F.get("r.bbox", F.lit(0))).alias("tx"),
                          F.coalesce("r.source_text", F.lit("")).alias("source_text"), F.coalesce("r.reading_order", "at").alias("reading_order"))
    return pages, regions, parsed.where(bad).drop("d")


def delivery_listing(pages: DataFrame, kind: str, width: int | None = None) -> DataFrame:
    """(project_id, image_id, member, source): numbered file names of one delivery.

    The number is padded to the width of the page count, or to ``width``.
    """
    placed = ranking.ranked(pages, ["project_id"], [_c("order_index"), _c("image_id")], F.floor(_c("order_index") / 4096), total="_pages")
    digits = F.lit(width) if width else F.length(_c("_pages").cast("string"))
    number = F.lpad(_c("position").cast("string"), F.greatest(digits, F.length(_c("position").cast("string"))), "0")
    source: Column = {"clean": F.coalesce("clean_path", "original_path"), "text_layer": _c("layer_path")}.get(kind, _c("rendered_path"))
    suffix = {"psd": F.lit(".psd"), "clean": F.coalesce(F.nullif(F.lower(F.regexp_extract(source, r"(\.[^./]+)$", 1)), F.lit("")), F.lit(".png"))}.get(
        kind, F.lit(".png"))
    return placed.where(source.isNotNull()).select("project_id", "image_id", F.concat(number, suffix).alias("member"), source.alias("source"))


def review_report(pages: DataFrame, checks: DataFrame, preserved: DataFrame, issues: DataFrame, failed: DataFrame) -> DataFrame:
    """(run_id, image_id, section, line_key, line): Markdown lines in page order."""
    line = lambda df, section, key, text: df.select(
        "run_id", "image_id", F.lit(section).alias("section"), key.cast("string").alias("line_key"), text.alias("line"))
    head = line(pages, 0, F.lit(""), F.concat(F.lit("Outcome: "), F.coalesce("outcome", F.lit("pending"))))
    rows = [line(checks, 1, _c("check"), F.concat(F.lit("- "), "check", F.lit(": "), "status")),
            line(preserved, 2, _c("region_id"), F.concat(F.lit("- Preserved artwork "), _c("region_id").cast("string"))),
            line(issues, 3, _c("issue_id"), F.concat(F.lit("- Issue "), "category", F.lit(" ["), "status", F.lit("]"))),
            line(failed, 4, _c("task_id"), F.concat(F.lit("- Task "), _c("task_id").cast("string"), F.lit(" ["), "status", F.lit("]")))]
    for r in rows:
        head = head.unionByName(r)
    return head


def fully_verified(pages: DataFrame) -> DataFrame:
    return pages.groupBy("run_id").agg(F.bool_and(F.coalesce(_c("outcome") == "passed", F.lit(False))).alias("fully_verified"))


def export_size_estimate(snapshots: DataFrame, files: DataFrame, prefix: str, keys: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """Files and bytes a snapshot refers to; repeats count, values of text keys do not.

    ``snapshots``: project_id, snapshot (JSON); ``files``: path, bytes.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    plain = F.regexp_replace("snapshot", rf'"(?:{"|".join(keys)})"\s*:\s*{string}', '""')
    tokens = F.regexp_extract_all(plain, F.lit(rf'({string}\s*:?)'), F.lit(1))  # a trailing colon marks a key
    values = F.filter(tokens, lambda v: ~v.endswith(":"))
    found = snapshots.select("project_id", F.explode(F.transform(values, lambda v: F.substring(v, F.lit(2), F.length(v) - 2))).alias("path"))
    return (found.where(F.startswith("path", F.lit(prefix))).join(files, "path").groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")))


def file_jobs(jobs: DataFrame, history_limit: int) -> DataFrame:
    """Every active job and the newest ``history_limit`` finished ones per project, newest first."""
    from pyspark.sql import Window
    active = _c("status").isin("QUEUED", "RUNNING", "CANCELLING", "PAUSED")
    turn = Window.partitionBy("project_id").orderBy(F.desc("created_us"), F.desc("job_id"))
    done = jobs.where(~active).withColumn("_n", F.row_number().over(turn)).where(_c("_n") <= history_limit).drop("_n")
    return jobs.where(active).unionByName(done).orderBy("project_id", F.desc("created_us"), F.desc("job_id"))
