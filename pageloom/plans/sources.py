"""S-01..S-12 and U-01..U-05 bound to the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import scoring as U
from pageloom.functions import text as X
from pageloom.operators import areas
from pageloom.plans.filters import ACTIVE
from pageloom.plans.registry import query
from pageloom.sources import archives as A
from pageloom.sources import manifests as N
from pageloom.sources import state as S

_c = F.col
_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("s01_read_state", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _s01(t):
    return t.spark.read.schema(_ORDERS).parquet(f"{t.folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s02_list_archive_members")
def _s02(t):
    @F.pandas_udf(T.BinaryType())
    def packed(turns: pd.Series, roles: pd.Series) -> pd.Series:
        def pack(turn, role):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(f"{role}/{turn}.png", role * int(turn % 7))
                z.writestr(f"__MACOSX/{turn}.png", "")
            return out.getvalue()
        return pd.Series([pack(a, b) for a, b in zip(turns, roles)])
    zips = t.page_texts.select(F.concat_ws("-", "image_id", "reading_order").alias("path"), packed("reading_order", "role").alias("content"))
    return A.list_archive_members(zips)


_MEMBER = ("case doc_id % 23 when 0 then concat('__MACOSX/', doc_id, '.png') when 1 then concat('.hidden', doc_id, '.png') when 2 then concat('a/', doc_id, '.txt') "
           "when 3 then concat('p/', n_chars % 50, '.PNG') else concat('p/', doc_id, '.png') end")
_MEM = ["cast(doc_id % 60 as {s}) as archive", f"case when doc_id % 60 = 7 and doc_id % 7 = 2 then '/abs.png' when doc_id % 60 = 11 then 'x.txt' else {_MEMBER} end as member",
        "n_chars as bytes", "doc_id % 29 = 0 as is_dir", "doc_id % 60 = 13 and doc_id % 3 = 0 as is_link", "doc_id % 60 = 17 as encrypted"]


@query("s03_validate_members", f"""
  with m as (select {', '.join(x.format(s='varchar') for x in _MEM)} from source_texts),
  n as (select *, regexp_extract(member, '([^/]*)/*$', 1) nm from m),
  p as (select *, not is_dir and not regexp_matches(member, '(^|/)__MACOSX(/|$)') and not starts_with(nm, '.') and regexp_matches(lower(nm), '\\.(jpg|jpeg|png|webp)$') pg from n),
  tw as (select distinct archive from (select archive, lower(member) from p where pg group by 1, 2 having count(*) > 1)),
  g as (select archive, count(*) n, bool_or(starts_with(member, '/')) us, bool_or(is_link) lk, bool_or(encrypted) en, sum(case when is_dir then 0 else bytes end) b,
    count(*) filter (pg) pages from p group by 1)
  select archive, pages, case when n > 20000 then 'too_many_entries' when us then 'unsafe_path' when lk then 'symlink' when en then 'encrypted'
    when b > 20000 then 'too_large' when archive in (select archive from tw) then 'duplicate_path' when pages > 2000 then 'too_many_pages' when pages = 0 then 'no_pages' end as problem from g""")
def _s03(t):
    return A.validate_members(t.source_texts.selectExpr(*[x.format(s="string") for x in _MEM]), 2000, 20000)


@query("s04_pages_from_members", """
  with m as (select doc_id % 50 as project_id, concat('Page', doc_id, '.png') member, 'page' || lpad(cast(doc_id as varchar), 20, '0') k from source_texts),
  x as (select project_id, max(order_index) mx from image_pages group by 1)
  select m.project_id, member, coalesce(mx, -1) + row_number() over (partition by m.project_id order by k) as order_index from m left join x using (project_id)""")
def _s04(t):
    return A.pages_from_members(t.source_texts.selectExpr("doc_id % 50 as project_id", "concat('Page', doc_id, '.png') as member"), t.image_pages)


def _manifest(t):
    regions = t.text_regions.select(
        "image_id", F.concat(F.lit("K"), "region_id").alias("region_key"), "x", "y", "w", "h", F.when(_c("overflow"), _c("x") + 5).alias("tx"),
        *[F.lit(None).cast("bigint").alias(n) for n in ("ty", "tw", "th")], "source_text", "translated_text", "confidence", "orientation", "reading_order",
        F.lit("Serif").alias("font_family"), "font_size")
    projects = t.projects.selectExpr("project_id", "name", "'' as description", "case when project_id % 3 = 0 then null else 'ja' end as source_language",
                                     "cast(language_key as string) as target_language")
    return N.export_manifest(projects, t.image_pages, regions)


@query("s05_export_manifest", """
  with r as (select image_id, list({region_id: concat('K', region_id), bbox: [cast(x as double), y, w, h], translated_bbox: [cast(case when overflow then x + 5 else x end as double), y, w, h],
      source_text: source_text, translated_text: translated_text, confidence: confidence, orientation: orientation, reading_order: reading_order,
      font: {family: 'Serif', size: cast(font_size as double)}} order by reading_order, concat('K', region_id)) rs from text_regions group by 1)
  select p.project_id, p.order_index, md5(to_json({schema_version: 2, project: {name: q.name, description: '', source_language: case when q.project_id % 3 = 0 then null else 'ja' end,
     target_language: cast(language_key as varchar)}, page: {id: p.image_id, order_index: p.order_index, width: width, height: height}, regions: rs})) as digest
  from image_pages p join projects q using (project_id) left join r on p.image_id = r.image_id""")
def _s05(t):
    return _manifest(t).select("project_id", "order_index", F.md5("manifest").alias("digest"))


@query("s06_import_manifest", """
  select image_id, concat('K', region_id) as region_key, cast(x as double) as x, cast(case when overflow then x + 5 else x end as double) as tx, source_text, reading_order
  from text_regions where image_id in (select image_id from image_pages where project_id in (select project_id from projects))""")
def _s06(t):
    return N.import_manifest(_manifest(t))[1].select("image_id", "region_key", "x", "tx", "source_text", "reading_order")


@query("s06_import_manifest_pages", """
  select p.project_id, p.image_id, p.order_index, q.name, case when q.project_id % 3 = 0 then 'ja' else 'ja' end as source_language,
    cast(language_key as varchar) as target_language from image_pages p join projects q using (project_id)""")
def _s06b(t):
    return N.import_manifest(_manifest(t))[0].drop("description")


@query("s07_delivery_listing", """
  with n as (select *, row_number() over (partition by project_id order by order_index, image_id) r, length(cast(count(*) over (partition by project_id) as varchar)) d from image_pages)
  select project_id, image_id, lpad(cast(r as varchar), cast(greatest(d, length(cast(r as varchar))) as integer), '0') || '.png' as member, coalesce(clean_path, original_path) as source from n""")
def _s07(t):
    return N.delivery_listing(t.image_pages, "clean")


@query("s08_review_report", """
  select run_id, image_id, 0 as section, '' as line_key, concat('Outcome: ', coalesce(outcome, 'pending')) as line from review_pages
  union all select run_id, image_id, 1, 'source', concat('- source: ', case when reviewed_version = 0 then 'pass' else 'fail' end) from review_pages
  union all select r.run_id, r.image_id, 2, cast(t.region_id as varchar), concat('- Preserved artwork ', t.region_id) from review_pages r join text_regions t using (image_id) where t.label = 'onomatopoeia'
  union all select r.run_id, r.image_id, 3, cast(i.issue_id as varchar), concat('- Issue ', category, ' [', i.status, ']') from review_pages r join review_issues i using (image_id)
  union all select r.run_id, r.image_id, 4, cast(task_id as varchar), concat('- Task ', task_id, ' [', k.status, ']') from review_pages r join processing_tasks k using (image_id) where k.status in ('FAILED', 'CANCELLED')""")
def _s08(t):
    r = t.review_pages.select("run_id", "image_id", "outcome", "reviewed_version")
    ids = r.select("run_id", "image_id")
    checks = r.select("run_id", "image_id", F.lit("source").alias("check"), F.when(_c("reviewed_version") == 0, "pass").otherwise("fail").alias("status"))
    return N.review_report(r, checks, ids.join(t.text_regions.where("label = 'onomatopoeia'").select("image_id", "region_id"), "image_id"),
                           ids.join(t.review_issues, "image_id"),
                           ids.join(t.processing_tasks.where("status in ('FAILED', 'CANCELLED')").select("image_id", "task_id", "status"), "image_id"))


@query("s08_fully_verified", "select run_id, bool_and(coalesce(outcome = 'passed', false)) as fully_verified from review_pages group by 1")
def _s08b(t):
    return N.fully_verified(t.review_pages)


@query("s09_consistent_snapshot")
def _s09(t):
    root, version = t.folder.rstrip("/").rsplit("/", 1)
    tables = S.consistent_snapshot(t.spark, root, version, ["orders", "lineitem"])
    return tables["orders"].join(tables["lineitem"].groupBy(_c("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("regions")), "o_orderkey").select(
        "o_orderkey", "regions")


@query("s10_export_size_estimate", """
  with s as (select doc_id % 50 as project_id, path as p from asset_files join source_texts on file_id = doc_id union all
    select doc_id % 50, path from asset_files join source_texts on file_id = doc_id where doc_id % 2 = 0)
  select project_id, count(*) as files, cast(sum(bytes) as bigint) as bytes from s join asset_files f on s.p = f.path group by s.project_id""".replace(
      "select project_id, count", "select s.project_id as project_id, count"))
def _s10(t):
    snap = F.to_json(F.struct(F.struct(_c("path").alias("mask"), F.array(F.when(_c("file_id") % 2 == 0, _c("path"))).alias("more")).alias("assets"),
                              _c("path").alias("source_text"), F.create_map("path", F.lit(1)).alias("index")))
    return N.export_size_estimate(t.asset_files.select("project_id", snap.alias("snapshot")), t.asset_files.select("path", "bytes"), "history/")


@query("s11_file_jobs", f"""
  with n as (select *, row_number() over (partition by batch_id order by created_us desc, task_id desc) r from processing_tasks where status not in {ACTIVE})
  select batch_id as project_id, task_id as job_id, status from processing_tasks where status in {ACTIVE} union all select batch_id, task_id, status from n where r <= 3""")
def _s11(t):
    return N.file_jobs(t.processing_tasks.selectExpr("batch_id as project_id", "task_id as job_id", "status", "created_us"), 3).select("project_id", "job_id", "status")


@query("s12_scan_directory")
def _s12(t):
    return S.scan_directory(S.list_files(t.spark, t.folder), t.folder, (".parquet",))


@query("u01_apply_scorer")
def _u01(t):
    return U.apply_scorer(t.source_texts.select("doc_id", "text"), "ocr", lambda: lambda pdf: pd.DataFrame({
        "doc_id": pdf.doc_id, "text": pdf.text.str.upper(), "confidence": (pdf.text.str.len() % 100) / 100.0, "orientation": "horizontal"}), "doc_id bigint")


@query("u02_passthrough", "select doc_id, md5(text) as digest, true as translation_fallback from source_texts")
def _u02(t):
    return U.passthrough(t.source_texts, "text").select("doc_id", F.md5("translated_text").alias("digest"), "translation_fallback")


@query("u03_udtf_text_chunks")
def _u03(t):
    U.register_table_functions(t.spark)
    t.source_texts.select("doc_id", "text").createOrReplaceTempView("pageloom_source_texts")
    return t.spark.sql("select s.doc_id, c.chunk, c.chunk_text from pageloom_source_texts s, lateral text_chunks(s.text, 4000) c")


@query("u04_udaf_p95", """select event_type, event_id % 200 as bucket, (list_sort(list(seconds)))[cast(ceil(count(*) * 0.95) as bigint)] as p95 from events_log group by 1, 2""")
def _u04(t):
    return t.events_log.groupBy("event_type", (_c("event_id") % 200).alias("bucket")).agg(U.p95_index("seconds").alias("p95"))


@query("u05_cached_score", """select doc_id, case when doc_id % 3 = 0 then 'cached' else 'scored' end as origin, n_chars as score from source_texts""")
def _u05(t):
    docs = t.source_texts.select("doc_id", "text")
    cache = U.cache_key(docs.where("doc_id % 3 = 0"), "cfg-1", ["doc_id", "text"]).select("cache_key", F.length("text").cast("bigint").alias("score"))
    fresh = lambda misses: misses.withColumn("score", F.length("text").cast("bigint"))
    hits, scored, _ = U.cached_score(docs, cache, "cfg-1", ["doc_id", "text"], fresh, "score")
    return hits.select("doc_id", F.lit("cached").alias("origin"), "score").union(scored.select("doc_id", F.lit("scored"), "score"))
