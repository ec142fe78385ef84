"""J-01..J-26 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.core.dealing import dealt
from pageloom.operators import layout as L
from pageloom.operators import lineage as N
from pageloom.operators import masks as M
from pageloom.plans.filters import NOW_US, _FULL  # noqa: F401
from pageloom.plans.registry import query

INTER = ("(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"
         " * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))")
_c = F.col


@query("j01_box_iou_join", f"""
  select * from (select a.image_id, a.region_id as first_id, b.region_id as second_id,
    round({INTER} * 1.0 / greatest(1, a.w * a.h + b.w * b.h - {INTER}), 6) as iou
  from text_regions a join text_regions b on a.image_id = b.image_id and a.region_id < b.region_id) where iou >= 0.3""")
def _j01(t):
    return L.box_iou_join(t.text_regions, 0.3).withColumn("iou", F.round("iou", 6))


@query("j02_box_coverage_join", f"""
  select a.image_id, a.region_id as inner_id, b.region_id as outer_id, round({INTER} * 1.0 / greatest(1, a.w * a.h), 6) as coverage
  from lettering a join panels b on a.image_id = b.image_id where {INTER} * 1.0 / greatest(1, a.w * a.h) >= 0.8""")
def _j02(t):
    return L.box_coverage_join(t.lettering, t.panels, 0.8).withColumn("coverage", F.round("coverage", 6))


_HOME = lambda item, box: f"""select a.image_id, a.region_id, arg_min(b.region_id,
    row(b.w * b.h, b.y, -b.x, b.label, b.region_id)) home
  from {item} a join {box} b on a.image_id = b.image_id where {INTER} * 1.0 / (a.w * a.h) >= 0.5 group by 1, 2"""  # noqa: E731


@query("j05_smallest_container", f"""
  with boxes as (select * from panels union all select * from bubbles), home as ({_HOME('lettering', 'boxes')})
  select l.image_id, l.region_id, home as container_id from lettering l left join home h
    on l.image_id = h.image_id and l.region_id = h.region_id""")
def _j05(t):
    return L.smallest_container(t.lettering, t.panels.unionByName(t.bubbles)).select("image_id", "region_id", "container_id")


_NODES = """nodes as (select image_id, region_id, x, y, w, h, label, cast(1 as double) as confidence from panels
  union all select image_id, region_id, x, y, w, h, label, cast(1 as double) from bubbles
  union all select image_id, region_id, x, y, w, h, label, confidence from lettering)"""


def _nodes(t):
    one = F.lit(1.0).alias("confidence")
    return (t.panels.select("*", one).unionByName(t.bubbles.select("*", one)).unionByName(t.lettering))


@query("j06_layout_tree", f"""
  with {_NODES},
  bp as ({_HOME('bubbles', 'panels')}), tb as ({_HOME('lettering', 'bubbles')}), tp as ({_HOME('lettering', 'panels')}),
  k as (select image_id, region_id, row(y, -x, label, -confidence, region_id) key from nodes),
  links as (
    select n.*, tb.home as bubble, tp.home as own, bpt.home as via, bp.home as bpanel
    from nodes n left join tb on n.label = 'text' and n.image_id = tb.image_id and n.region_id = tb.region_id
      left join tp on n.label = 'text' and n.image_id = tp.image_id and n.region_id = tp.region_id
      left join bp bpt on n.image_id = bpt.image_id and tb.home = bpt.region_id
      left join bp on n.label = 'bubble' and n.image_id = bp.image_id and n.region_id = bp.region_id),
  p as (select *, case label when 'text' then coalesce(bubble, via, own) when 'bubble' then bpanel end as parent_id,
      case label when 'text' then coalesce(via, own) end as text_panel_id,
      case label when 'text' then case when bubble is not null then via else own end when 'bubble' then bpanel end as top
    from links),
  paths as (select p.*, list_filter([k1.key, k2.key, k3.key], lambda v: v is not null) path
    from p left join k k1 on p.image_id = k1.image_id and p.top = k1.region_id
      left join k k2 on p.image_id = k2.image_id and p.bubble = k2.region_id
      join k k3 on p.image_id = k3.image_id and p.region_id = k3.region_id)
  select image_id, region_id, label, case label when 'text' then coalesce(bubble, own) else parent_id end as parent_id,
    text_panel_id, row_number() over (partition by image_id order by path) as preorder from paths""")
def _j06(t):
    return L.layout_tree(_nodes(t))


RUNS = lambda name, table: f"""{name} as (select image_id, region_id as mask_id,
  unnest(generate_series(y // 10, greatest(y // 10, (y + h) // 10 - 1))) as y, x // 10 as x0,
  greatest(x // 10 + 1, (x + w) // 10) as x1 from {table})"""  # noqa: E731
_ASSIGN = f"""{RUNS('tr', 'lettering')}, {RUNS('br', 'bubbles')},
  ta as (select image_id, mask_id, sum(x1 - x0) area from tr group by 1, 2),
  ba as (select image_id, mask_id, sum(x1 - x0) area from br group by 1, 2),
  sh as (select a.image_id, a.mask_id, b.mask_id other, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) n
    from tr a join br b on a.image_id = b.image_id and a.y = b.y and a.x0 < b.x1 and b.x0 < a.x1 group by 1, 2, 3),
  asg as (select sh.image_id, sh.mask_id, arg_min(other, row(ba.area, other)) bubble_id, arg_min(n * 1.0 / ta.area, row(ba.area, other)) cov
    from sh join ta using (image_id, mask_id) join ba on sh.image_id = ba.image_id and other = ba.mask_id
    where n * 1.0 / ta.area >= 0.9 group by 1, 2)"""


def _runs(df, *keys):
    """Scan lines of boxes, dealt by region or by ``keys`` while they are still boxes."""
    return M.boxes_to_runs(dealt(df, *(keys or ("image_id", "region_id"))), scale=10)


def _assigned(t):
    return M.assign_balloon(_runs(t.lettering), _runs(t.bubbles))


@query("j07_assign_balloon", f"with {_ASSIGN} select image_id, mask_id, bubble_id, round(cov, 6) as coverage from asg")
def _j07(t):
    return _assigned(t).withColumn("coverage", F.round("coverage", 6))


_TOUCH = f"""select image_id, region_id from lettering a where exists (select 1 from bubbles b where a.image_id = b.image_id
  and {INTER} > 0.1 * a.w * a.h)"""


@query("j08_touches_balloon", _TOUCH)
def _j08(t):
    return L.touches_balloon(t.lettering, t.bubbles).select("image_id", "region_id")


@query("j09_text_role", f"""
  with {_ASSIGN}, touch as ({_TOUCH})
  select l.image_id, l.region_id, case when bubble_id is not null then 'dialogue'
    when t.region_id is null and ta.area >= 24 then 'free_text' else 'unknown' end as role
  from lettering l join ta on l.image_id = ta.image_id and l.region_id = ta.mask_id
    left join asg on l.image_id = asg.image_id and l.region_id = asg.mask_id
    left join touch t on l.image_id = t.image_id and l.region_id = t.region_id""")
def _j09(t):
    texts = t.lettering.join(M.area(_runs(t.lettering)).select(
        "image_id", _c("mask_id").alias("region_id"), _c("area").alias("mask_pixels")), ["image_id", "region_id"])
    homes = _assigned(t).withColumnRenamed("mask_id", "region_id")
    return L.text_role(texts, homes, L.touches_balloon(t.lettering, t.bubbles)).select("image_id", "region_id", "role")


@query("j10_panel_of_centre", """
  select a.image_id, a.region_id, max(b.region_id) as panel_id from lettering a join panels b on a.image_id = b.image_id
    and a.x + a.w / 2 between b.x and b.x + b.w and a.y + a.h / 2 between b.y and b.y + b.h
  group by 1, 2 having count(*) = 1""")
def _j10(t):
    return L.panel_of_centre(t.lettering, t.panels)


_CK = """select event_id as checkpoint_id, user_id as workflow_id, event_type as stage, event_id as attempt, k % 5 as input_fingerprint,
  case event_id % 4 when 2 then 'FAILED' when 3 then 'UNKNOWN' else 'SUCCEEDED' end as status from events_log"""


def checkpoints(t):
    return t.events_log.selectExpr(
        "event_id as checkpoint_id", "user_id as workflow_id", "event_type as stage", "event_id as attempt",
        "k % 5 as input_fingerprint", "ts_us", "seconds", "centis",
        "case event_id % 4 when 2 then 'FAILED' when 3 then 'UNKNOWN' else 'SUCCEEDED' end as status")


@query("j11_latest_successful", f"""select workflow_id, stage, input_fingerprint, max(attempt) as attempt, max(checkpoint_id) as checkpoint_id
  from ({_CK}) where status = 'SUCCEEDED' group by 1, 2, 3""")
def _j11(t):
    return N.latest_successful(checkpoints(t))


@query("j12_previous_page", """select project_id, image_id, order_index, lag(image_id) over (partition by project_id
  order by order_index, image_id) as previous_image_id from image_pages""")
def _j12(t):
    return N.previous_page(t.image_pages).select("project_id", "image_id", "order_index", "previous_image_id")


_TASK_COLS = ("task_id", "batch_id", "generation", "status", "task_id % 11 = 0 as pause_requested",
              "task_id % 7 = 0 as has_context", "case when task_id % 5 = 0 then 'translation' else 'rendering' end as end_stage",
              "task_id % 3 <> 0 as repairs_source")
_TCK = ("event_id * 2 as task_id", "(event_id * 2) % 3 as generation",
        "case event_type when 'click' then 'translation' when 'view' then 'ocr' else 'inpainting' end as stage",
        "case when event_id % 4 < 3 then 'SUCCEEDED' else 'FAILED' end as status")


@query("j13_dependency_state", f"""
  with q as (select {', '.join(_TASK_COLS)}, lag(task_id) over (partition by batch_id order by task_id) dependency_id from processing_tasks),
  c as (select {', '.join(_TCK)} from events_log),
  d as (select task_id, generation, bool_or(stage = 'translation') tr, bool_or(stage = 'ocr') oc, bool_or(stage = 'inpainting') re
    from c where status = 'SUCCEEDED' group by 1, 2)
  select q.task_id, q.dependency_id, case when q.status <> 'QUEUED' or q.pause_requested then 'stopped'
      when q.dependency_id is null or q.has_context then 'ready' when p.task_id is null then 'failed'
      when coalesce(pd.tr, false) then 'ready' when p.status in ('FAILED', 'CANCELLED', 'COMPLETED') then 'failed'
      when q.end_stage = 'translation' then case when coalesce(od.oc, false) then 'waiting' else 'repair' end
      when q.repairs_source and not coalesce(od.re, false) then 'repair' else 'waiting' end as state
  from q left join q p on q.dependency_id = p.task_id left join d pd on p.task_id = pd.task_id and p.generation = pd.generation
    left join d od on q.task_id = od.task_id and q.generation = od.generation""")
def _j13(t):
    from pageloom.core import ranking
    tasks = ranking.previous_row(t.processing_tasks.selectExpr(*_TASK_COLS), ["batch_id"], ["task_id"],
                                 F.floor(_c("task_id") / 4096), ["task_id"], "dependency_").withColumnRenamed(
        "dependency_task_id", "dependency_id")
    return N.dependency_state(tasks, t.events_log.selectExpr(*_TCK))


FIELDS = ["x", "y", "w", "h", "source_text", "locked"]
_SIDE = {
    "before": (FIELDS, "font_size <> 7"),
    "after": (["case when font_size = 9 then x + 5 else x end as x", "y", "case when font_size = 11 then w + 1 else w end as w", "h",
               "case when font_size = 10 then concat(source_text, '!') else source_text end as source_text", "locked"],
              "font_size <> 8"),
    "other": (["case when font_size in (9, 12) then x + 5 else x end as x", "case when font_size = 10 then y + 1 else y end as y",
               "case when font_size = 11 then w + 2 else w end as w",
               "case when font_size = 8 and locked then h + 1 else h end as h", "source_text", "locked"], "font_size <> 13"),
}


def _side(t, name):
    columns, where = _SIDE[name]
    return t.text_regions.where(where).selectExpr("image_id", "region_id", *columns)


def _side_sql(name):
    columns, where = _SIDE[name]
    return f"(select image_id, region_id, {', '.join(columns)} from text_regions where {where})"


_V = lambda c: f"cast({c} as varchar)"
DELTA_SQL = f"""with b as {_side_sql('before')}, a as {_side_sql('after')}, j as (select coalesce(a.image_id, b.image_id) image_id,
    coalesce(a.region_id, b.region_id) region_id, a.region_id is not null isnew, b.region_id is not null isold,
    {', '.join(f'{_V("a." + c)} a_{c}, {_V("b." + c)} b_{c}' for c in FIELDS)}
  from b full join a on a.image_id = b.image_id and a.region_id = b.region_id)
  select image_id, region_id, 'delete' as op, cast(null as varchar) as field, cast(null as varchar) as value from j where not isnew
  """ + " ".join(f"union all select image_id, region_id, 'put', '{c}', a_{c} from j where isnew and (not isold or a_{c} is distinct from b_{c})"
                 for c in FIELDS)


@query("j14_delta", DELTA_SQL)
def _j14(t):
    return N.delta(_side(t, "before"), _side(t, "after"), FIELDS)


@query("j15_apply_delta", f"select * from {_side_sql('after')}")
def _j15(t):
    before = _side(t, "before")
    return N.apply_delta(before, N.delta(before, _side(t, "after"), FIELDS), FIELDS)


_CELLS = " union all ".join(
    f"select image_id, region_id, '{c}' as field, {_V('b_' + c)} b, {_V('l_' + c)} l, {_V('r_' + c)} r, isb, isl, isr from j" for c in FIELDS)


@query("j16_merge3", f"""
  with b as {_side_sql('before')}, l as {_side_sql('after')}, r as {_side_sql('other')},
  ids as (select image_id, region_id from b union select image_id, region_id from l union select image_id, region_id from r),
  j as (select ids.*, b.region_id is not null isb, l.region_id is not null isl, r.region_id is not null isr,
    {', '.join(f'b.{c} b_{c}, l.{c} l_{c}, r.{c} r_{c}' for c in FIELDS)}
    from ids left join b using (image_id, region_id) left join l using (image_id, region_id) left join r using (image_id, region_id)),
  e as (select *, {' or '.join(f'l_{c} is distinct from b_{c}' for c in FIELDS)} as le,
    {' or '.join(f'r_{c} is distinct from b_{c}' for c in FIELDS)} as re from j),
  torn as (select image_id, region_id from e where isb and ((not isl and isr and re) or (not isr and isl and le))),
  gone as (select image_id, region_id from e where isb and (not isl or not isr)),
  cells as ({_CELLS})
  select image_id, region_id, cast(null as varchar) as field, cast(null as varchar) as value, true as conflict from torn
  union all
  select image_id, region_id, field, case when isl and isr and l is distinct from r and l is distinct from b and r is distinct from b then null
      when not isl then r when not isr then l when l is not distinct from b then r else l end as value,
    isl and isr and l is distinct from r and (not isb or l is distinct from b) and (not isb or r is distinct from b) as conflict
  from cells where (image_id, region_id) not in (select image_id, region_id from gone)""")
def _j16(t):
    return N.merge3(_side(t, "before"), _side(t, "after"), _side(t, "other"), FIELDS)


@query("j17_validate_artifacts", """
  with m as (select file_id % 97 as checkpoint_id, path, bytes + case when file_id % 50 = 0 then 1 else 0 end bytes,
      case when file_id % 60 = 0 then 'x' else sha end sha from asset_files)
  select checkpoint_id, count(*) as files, count(*) filter (not coalesce(m.bytes = f.bytes and m.sha = f.sha, false)) as bad,
    case when count(*) filter (not coalesce(m.bytes = f.bytes and m.sha = f.sha, false)) > 0 then 'INVALID' else 'SUCCEEDED' end as status
  from m left join (select * from asset_files where age_minutes > 0) f using (path) group by 1""")
def _j17(t):
    manifest = t.asset_files.selectExpr("file_id % 97 as checkpoint_id", "path", "bytes + if(file_id % 50 = 0, 1, 0) as bytes",
                                        "if(file_id % 60 = 0, 'x', sha) as sha")
    return N.validate_artifacts(manifest, t.asset_files.where("age_minutes > 0"))


_ORPHANS = """select project_id, f.path, bytes, row_number() over (partition by project_id order by f.path) n
  from asset_files f where age_minutes >= 10 and file_id not in (select file_id from asset_references)
    and not exists (select 1 from (select 'history/' || source as d from source_texts group by source having max(n_chars) % 2 = 0)
      where starts_with(f.path, d || '/'))"""


def orphans(t, cap=None):
    refs = t.asset_references.join(t.asset_files, "file_id").select("path")
    locked = (t.source_texts.groupBy("source").agg(F.max("n_chars").alias("m")).where("m % 2 = 0")
              .select(F.concat(F.lit("history/"), "source").alias("directory")))
    return N.orphan_assets(t.asset_files, refs, 10, locked, cap)


@query("j18_orphan_assets", f"select project_id, path, bytes from ({_ORPHANS})")
def _j18(t):
    return orphans(t).select("project_id", "path", "bytes")


@query("j19_reconcile_ids", """
  with q as (select image_id, reading_order from page_texts where role = 'user'),
  g as (select image_id, reading_order - 1 as reading_order, count(*) n, bool_or(regexp_matches(text, '[^\\s\\p{Z}\\p{Cf}\\p{Cc}\\p{Mn}\\p{Me}]')) t from page_texts where role <> 'user' group by 1, 2)
  select coalesce(q.image_id, g.image_id) as image_id, coalesce(q.reading_order, g.reading_order) as region_id,
    case when q.image_id is null then 'extra' when n is null then 'missing' when n > 1 then 'duplicate' when not t then 'blank' else 'ok' end as status
  from q full join g on q.image_id = g.image_id and q.reading_order = g.reading_order""")
def _j19(t):
    asked = t.page_texts.where("role = 'user'").selectExpr("image_id", "reading_order as region_id")
    got = t.page_texts.where("role <> 'user'").selectExpr("image_id", "reading_order - 1 as region_id", "text")
    return N.reconcile_ids(asked, got)


_REFS = ("select image_id, cast(region_id as {s}) as ref from {r} where font_size % 2 = 0",
         "select image_id, concat('K-', region_id) from {r} where font_size % 3 = 0",
         "select image_id, concat('nope-', region_id) from {r} where font_size = 7")


@query("j20_resolve_regions", f"""
  with refs as ({' union all '.join(q.format(s='varchar', r='text_regions') for q in _REFS)}),
  f as (select r.image_id, t.region_id, count(*) n from refs r left join text_regions t on r.image_id = t.image_id
    and (r.ref = cast(t.region_id as varchar) or r.ref = concat('K-', t.region_id)) group by 1, 2)
  select image_id, count(*) filter (region_id is not null) as resolved,
    cast(coalesce(sum(n) filter (region_id is null), 0) as bigint) as unknown,
    count(*) filter (region_id is not null and n > 1) as doubled,
    count(*) filter (region_id is null or n > 1) = 0 as ok from f group by 1""")
def _j20(t):
    r = t.text_regions.withColumn("region_key", F.concat(F.lit("K-"), "region_id"))
    refs = (r.where("font_size % 2 = 0").select("image_id", _c("region_id").cast("string").alias("ref"))
            .union(r.where("font_size % 3 = 0").select("image_id", "region_key"))
            .union(r.where("font_size = 7").select("image_id", F.concat(F.lit("nope-"), "region_id"))))
    return N.resolve_regions(refs, r)


@query("j21_stale_reviews", """select run_id, image_id, case when outcome is null then 'pending'
  when reviewed_version <> current_version then 'stale' else outcome end as review_status from review_pages""")
def _j21(t):
    return N.stale_reviews(t.review_pages).select("run_id", "image_id", "review_status")


@query("j22_page_owners", f"""select run_id, image_id from review_pages where run_id in (select run_id from review_pages
  where lease_expires_us > {NOW_US} or correction_open or outcome is null or reviewed_version <> current_version
    or (outcome = 'issues' and not deliver_with_issues))""")
def _j22(t):
    return N.page_owners(t.review_pages, NOW_US)


@query("j23_version_guard", """
  with u as (select image_id, region_id, font_size, updated_us + case when font_size = 6 then 1 else 0 end as v from text_regions where font_size <> 9),
  c as (select u.*, coalesce(v = updated_us, false) ok from u left join text_regions t using (image_id, region_id))
  select image_id, region_id, bool_and(ok) over (partition by image_id) as applied, ok as applied_alone from c""")
def _j23(t):
    rows = t.text_regions.selectExpr("image_id", "region_id", "updated_us as version")
    updates = t.text_regions.where("font_size <> 9").selectExpr(
        "image_id", "region_id", "updated_us + if(font_size = 6, 1, 0) as version")
    alone = N.version_guard(updates, rows, None).select("image_id", "region_id", _c("applied").alias("applied_alone"))
    return N.version_guard(updates, rows, ["image_id"]).join(alone, ["image_id", "region_id"]).drop("version")


CONFIG = ["source_language", "target_language", "context", "settings"]
_CONFIG = ["language_key as source_language", "segment as target_language", "name as context", "updated_us as settings"]
_FROZEN = ["case when project_id % 5 = 0 then language_key + 1 else language_key end as source_language",
           "case when project_id % 7 = 0 then null else segment end as target_language", "name as context",
           "case when project_id % 3 = 0 then updated_us + 1 else updated_us end as settings"]


@query("j24_configuration_drift", """
  select project_id as run_id, 'source_language' as field from projects where project_id % 5 = 0
  union all select project_id, 'target_language' from projects where project_id % 7 = 0
  union all select project_id, 'settings' from projects where project_id % 3 = 0""")
def _j24(t):
    runs = t.projects.selectExpr("project_id as run_id", "project_id", *_FROZEN)
    return N.configuration_drift(runs, t.projects.selectExpr("project_id", *_CONFIG), CONFIG)


_OPS = ["event_id as operation_id", "case when k % 3 = 0 then 'COMPLETED' else 'UNKNOWN' end as status",
        "case event_type when 'click' then 'workflow_advance' when 'view' then 'task_retry' when 'error' then 'project_import' "
        "when 'signup' then 'workflow_export' else 'page_edit' end as tool",
        "case when k % 4 = 1 then 'claim' else 'start' end as action", "k % 10 = 7 as has_receipt"]
_TAGGED = ["task_id", "case when task_id % 2 = 0 then task_id end as operation_id"]


@query("j25_recover_operation", f"""
  with ops as (select {', '.join(_OPS)} from events_log),
  tk as (select {', '.join(_TAGGED)} from processing_tasks),
  m as (select event_id as operation_id, event_id * 2 + d.i as task_id from events_log, (values (0), (1)) d(i) where k % 5 = 0),
  adm as (select m.operation_id, bool_and(tk.task_id is not null) ok from m left join tk on m.task_id = tk.task_id group by 1),
  bt as (select distinct operation_id from tk where operation_id is not null),
  bj as (select distinct file_id * 9 as operation_id from asset_files),
  o as (select ops.*, case when status <> 'UNKNOWN' then 'settled' when has_receipt then 'receipt'
      when tool = 'workflow_advance' and action = 'claim' then 'not_applied'
      when tool = 'workflow_advance' and adm.ok then 'tasks_admitted'
      when tool in ('workflow_advance', 'task_retry') and adm.ok is null and bt.operation_id is not null then 'task_found'
      when tool in ('project_import', 'workflow_export') and bj.operation_id is not null then 'job_found' else 'unknown' end as outcome
    from ops left join adm using (operation_id) left join bt on bt.operation_id = ops.operation_id left join bj on bj.operation_id = ops.operation_id)
  select operation_id, outcome, case when outcome = 'unknown' then 'UNKNOWN' when status = 'UNKNOWN' then 'COMPLETED' else status end as status from o""")
def _j25(t):
    e = t.events_log
    manifest = e.where("k % 5 = 0").select(_c("event_id").alias("operation_id"), F.explode(
        F.array(_c("event_id") * 2, _c("event_id") * 2 + 1)).alias("task_id"))
    return N.recover_operation(e.selectExpr(*_OPS), manifest, t.processing_tasks.selectExpr(*_TAGGED),
                               t.asset_files.selectExpr("file_id * 9 as operation_id"))


@query("j26_select_model", """
  with q as (select event_id as request_id, concat('Brand#', k % 30) as kind, case when k % 2 = 0 then 'start' else 'later' end as stage,
     case when user_id % 3 = 0 then 'ECONOMY' when user_id % 3 = 1 then 'red widget' end as requested from events_log),
  b as (select request_id, arg_max(m, row(m.updated, m.model_id)) m from q join model_configs m using (kind)
    where m.enabled and case when stage = 'start' and requested is not null then m.provider = requested or m.name = requested else m.is_default end
    group by 1)
  select q.request_id, q.kind, (b.m).model_id as model_id,
    coalesce((b.m).provider, case when stage = 'start' then requested end) in ('ECONOMY', 'PROMO') as cloud
  from q left join b using (request_id)""")
def _j26(t):
    asked = t.events_log.selectExpr(
        "event_id as request_id", "concat('Brand#', k % 30) as kind", "if(k % 2 = 0, 'start', 'later') as stage",
        "'start' as start_stage", "case when user_id % 3 = 0 then 'ECONOMY' when user_id % 3 = 1 then 'red widget' end as requested")
    return N.select_model(asked, t.model_configs, ["ECONOMY", "PROMO"])
