"""W-01..W-19 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.core.dealing import dealt
from pageloom.operators import masks as M
from pageloom.operators import ordering as O
from pageloom.plans.joins import RUNS, _runs
from pageloom.plans.registry import query

_c = F.col


def _seq(df):
    return df.withColumn("seq", _c("region_id"))


@query("w01_reading_order")
def _w01(t):
    return O.reading_order(_seq(t.text_regions))


@query("w02_panel_reading_order")
def _w02(t):
    place = lambda df: dealt(_seq(df.select("image_id", "region_id", "x", "y", "w", "h")), "image_id")
    return O.panel_reading_order(place(t.lettering), place(t.panels))


@query("w03_widest_gutter", """
  with b as (select image_id, y, y + h e from text_regions),
  g as (select image_id, y - max(e) over (partition by image_id order by y groups between unbounded preceding and 1 preceding) gap, y from b)
  select image_id, max(gap) as gap, arg_max(y, row(gap, y)) as cut_at from g where gap >= 2 group by 1""")
def _w03(t):
    return O.widest_gutter(t.text_regions, "y", "h")


@query("w04_renumber_keys", """
  with r as (select *, case when font_size % 3 = 0 then 'X1' else 'R' || lpad(cast(reading_order * 3 as varchar), 3, '0') end k from text_regions)
  select image_id, region_id, 'R' || lpad(cast(row_number() over (partition by image_id order by case when font_size % 3 = 0 then 1 else 0 end,
    case when font_size % 3 = 0 then reading_order else reading_order * 3 end, region_id) as varchar), 3, '0') as new_key from r""")
def _w04(t):
    r = t.text_regions.withColumn("region_key", F.when(_c("font_size") % 3 == 0, "X1").otherwise(F.format_string("R%03d", _c("reading_order") * 3)))
    return O.renumber_keys(r).select("image_id", "region_id", "new_key")


_REV = ["user_id as region_id", "event_id as seq", "k % 3 as bbox", "case when k % 2 = 0 then null else k % 5 end as target"]


@query("w05_sync_pending", f"""
  with r as (select {', '.join(_REV)} from events_log), l as (select *, lag(seq) over o ps, lag(bbox) over o pb, lag(target) over o pt from r
    window o as (partition by region_id order by seq)),
  g as (select region_id, max(seq) filter (ps is not null and bbox is distinct from pb) s,
    max(seq) filter (ps is not null and target is distinct from pt) t from l group by 1)
  select region_id, s is not null and (t is null or s > t) as pending from g""")
def _w05(t):
    return O.sync_pending(t.events_log.selectExpr(*_REV), ["bbox"], ["target"], F.floor(_c("seq") / 4096))


_ENTRY = ["user_id as project_id", "event_id as entry_id", "event_type as action", "event_id % 7 <> 0 as applied",
          "k = 50 as pending", "k % 10 = 3 as unchanged"]


@query("w06_history_cursor", f"""
  with e as (select {', '.join(_ENTRY)} from events_log)
  select project_id, count(*) filter (applied and not pending) as undo_count, count(*) filter (not applied and not pending) as redo_count,
    max(entry_id) filter (applied and not pending) as undo_id, min(entry_id) filter (not applied and not pending) as redo_id,
    arg_max(action, entry_id) filter (applied and not pending) as undo_label,
    arg_min(action, entry_id) filter (not applied and not pending) as redo_label, bool_or(pending) as pending from e group by 1""")
def _w06(t):
    return O.history_cursor(t.events_log.selectExpr(*_ENTRY))


@query("w07_trim_history", f"""
  with e as (select {', '.join(_ENTRY)} from events_log), n as (select project_id, max(entry_id) last, arg_max(unchanged, entry_id) u from e group by 1),
  j as (select e.*, u, entry_id = last as is_last from e join n using (project_id)),
  busy as (select *, row_number() over (partition by project_id, pending order by entry_id desc) r from j where not u and (applied or is_last))
  select project_id, entry_id, action from j where u and not is_last union all select project_id, entry_id, action from busy where pending or r <= 30""")
def _w07(t):
    return O.trim_history(t.events_log.selectExpr(*_ENTRY), 30).select("project_id", "entry_id", "action")


_LOG = ["user_id as project_id", "event_id as entry_id", "k % 20 as region_id", "concat('b', k, event_type) as before",
        "case when k % 9 = 0 then null else concat('a', event_id) end as after", "event_id < 9000 and event_id % 7 <> 0 as applied"]


@query("w08_replay_history", f"""
  with e as (select {', '.join(_LOG)} from events_log), h as (select project_id, max(entry_id) filter (applied) head from e group by 1),
  g as (select e.project_id, region_id, arg_max_null(after, entry_id) filter (applied) a, bool_or(applied) x, arg_min_null(before, entry_id) b,
    coalesce(bool_or(entry_id = head), false) restored, max(before) filter (entry_id = head) s from e join h using (project_id) group by 1, 2)
  select project_id, region_id, restored, case when restored then s when x then a else b end as snapshot from g""")
def _w08(t):
    return O.replay_history(t.events_log.selectExpr(*_LOG), True)


@query("w09_page_context", """
  with x as (select image_id, reading_order, least(length(text), 2000) s, least(length(text) % 700, 2000) tr, text from page_texts),
  c as (select *, 4000 - coalesce(sum(s + tr) over (partition by image_id order by reading_order rows between unbounded preceding and 1 preceding), 0) as rem,
    row_number() over (partition by image_id order by reading_order) n from x)
  select image_id, reading_order, md5(substr(text, 1, cast(least(2000, rem) as int))) as source_md5,
    cast(greatest(0, least(tr, rem - s)) as bigint) as translation_length from c where n <= 200 and rem > 0""")
def _w09(t):
    texts = t.page_texts.select("image_id", _c("reading_order").alias("region_id"), "reading_order", _c("text").alias("source_text"),
                                F.substring("text", F.lit(1), F.length("text") % 700).alias("translated_text"))
    return O.page_context(texts, 4000).select("image_id", "reading_order", F.md5("source").alias("source_md5"),
                                              F.length("translation").cast("bigint").alias("translation_length"))


@query("w10_islands", """
  with f as (select user_id, k as pos from events_log group by 1, 2), g as (select *, pos - row_number() over (partition by user_id order by pos) i from f)
  select user_id, min(pos) as x0, max(pos) + 1 as x1 from g group by user_id, i""")
def _w10(t):
    return O.islands(t.events_log.selectExpr("user_id", "k as pos", "true as flag"), ["user_id"])


# Text lines: the regions of a page read top to bottom stand in for the lines of one mask.
_LINES = """ln as (select image_id as mask_id, row_number() over (partition by image_id order by y, region_id) as line_no, y as y0, y + h as y1,
    font_size % 2 as owner from text_regions),
  ty as (select mask_id, median(y1 - y0) height, coalesce(median(greatest(0, gap)), 0) gap from (select *, lead(y0) over (partition by mask_id order by line_no) - y1 as gap from ln) group by 1)"""


def _lines(t):
    from pageloom.core import ranking
    lines = ranking.ranked(t.text_regions, ["image_id"], [_c("y"), _c("region_id")], F.floor(_c("y") / 64), name="line_no").select(
        _c("image_id").alias("mask_id"), "line_no", _c("y").alias("y0"), (_c("y") + _c("h")).alias("y1"), (_c("font_size") % 2).alias("owner"))
    nxt = ranking.previous_row(lines, ["mask_id"], ["line_no"], F.floor(_c("line_no") / 256), ["y1"], "was_")
    return lines, nxt.groupBy("mask_id").agg(F.median(_c("y1") - _c("y0")).alias("height"), F.coalesce(
        F.median(F.greatest(F.lit(0), F.when(_c("was_y1").isNotNull(), _c("y0") - _c("was_y1")))), F.lit(0.0)).alias("gap"))


@query("w11_split_lines", f"""
  with {_LINES}, l as (select *, lag(y1) over o py, lag(owner) over o po from ln join ty using (mask_id) window o as (partition by mask_id order by line_no))
  select mask_id, line_no, owner, cast(sum(case when py is not null and (owner <> po or y0 - py > greatest(height * 0.9, gap * 1.5)) then 1 else 0 end)
    over (partition by mask_id order by line_no) as bigint) as piece from l""")
def _w11(t):
    lines, typical = _lines(t)
    # least() skips nulls, greatest(0, null) is 0 in both engines; the first line has no gap.
    return O.split_lines(lines, typical)


_PROFILE = f"""{RUNS('rr', 'text_regions')}, merged as (select image_id as mask_id, y as pos, sum(x1 - x0) as ink from rr group by 1, 2),
  ext as (select mask_id, min(pos) lo, max(pos) + 1 hi from merged group by 1),
  grid as (select mask_id, unnest(generate_series(lo, hi - 1)) as pos from ext),
  pf as (select g.mask_id, g.pos, coalesce(ink, 0) as ink from grid g left join merged m using (mask_id, pos)),
  ty as (select mask_id, 3.0 as height from ext)"""


def _profile(t):
    rows = _runs(t.text_regions, "image_id").groupBy(_c("image_id").alias("mask_id"), _c("y").alias("pos")).agg(F.sum(_c("x1") - _c("x0")).alias("ink"))
    # each line brings the empty ones up to the next, so that no grid has to be joined
    next_line = F.lead("pos").over(Window.partitionBy("mask_id").orderBy("pos"))
    spread = rows.withColumn("_next", next_line).select("mask_id", _c("pos").alias("_at"), "ink", F.explode(
        F.sequence("pos", F.coalesce(_c("_next") - 1, _c("pos")))).alias("pos"))
    return spread.select("mask_id", "pos", F.when(_c("pos") == _c("_at"), _c("ink")).otherwise(0).alias("ink"))


@query("w12_split_gutters", f"""
  with {_PROFILE}, z as (select mask_id, pos - row_number() over (partition by mask_id order by pos) i, pos from pf where ink = 0),
  em as (select mask_id, min(pos) a, max(pos) + 1 b from z group by mask_id, i),
  inn as (select em.*, b - a as len, lo, hi from em join ext using (mask_id) where a > lo and b < hi),
  nm as (select mask_id, median(len) n from inn group by 1),
  wide as (select inn.* from inn join nm using (mask_id) join ty using (mask_id) where len >= greatest(4.0, height * 0.9, n * 1.8)),
  cuts as (select mask_id, (a + b) // 2 as c from wide union all select distinct mask_id, lo from wide),
  bd as (select c.mask_id, c as start, coalesce(lead(c) over (partition by c.mask_id order by c), hi) as stop from cuts c join ext using (mask_id)),
  pt as (select bd.mask_id, start, stop, cast(sum(ink) as bigint) ink from bd join pf on bd.mask_id = pf.mask_id and pos >= start and pos < stop group by 1, 2, 3)
  select * from pt where mask_id not in (select mask_id from pt where ink < 36)""")
def _w12(t):
    p = _profile(t)
    return O.split_gutters(p, t.image_pages.select(_c("image_id").alias("mask_id"), F.lit(3.0).alias("height")))


@query("w13_merge_tiny_bands")
def _w13(t):
    bands = O.islands(_profile(t).select("mask_id", "pos", (_c("ink") > 0).alias("flag")), ["mask_id"])
    return O.merge_tiny_bands(bands, t.image_pages.select(_c("image_id").alias("mask_id"), F.lit(16.0).alias("height")))


@query("w14_pack_requests")
def _w14(t):
    items = t.page_texts.select("image_id", _c("reading_order").alias("seq"), "text")
    return O.pack_requests(items)


@query("w15_reorder_pages", """
  with w as (select project_id, image_id, -order_index as position from image_pages where not (project_id % 5 = 0 and image_id % 3 = 0)
    union all select project_id, image_id, 0 from image_pages where project_id % 7 = 0),
  a as (select project_id, image_id, min(position) position, count(*) n from w group by 1, 2),
  j as (select p.project_id, p.image_id, position, coalesce(n = 1, false) ok from image_pages p left join a using (project_id, image_id))
  select project_id, image_id, case when bool_and(ok) over (partition by project_id) then position end as new_index from j""")
def _w15(t):
    p = t.image_pages
    w = p.where("not (project_id % 5 = 0 and image_id % 3 = 0)").selectExpr("project_id", "image_id", "-order_index as position").union(
        p.where("project_id % 7 = 0").selectExpr("project_id", "image_id", "cast(0 as bigint)"))
    return O.reorder_pages(p, w)


_MOVES = "select project_id, max(image_id) image_id, min(order_index) target_index from image_pages group by project_id"


@query("w15_move_page", f"""
  with m as ({_MOVES}), s as (select p.project_id, order_index f, target_index t from image_pages p join m using (project_id, image_id))
  select project_id, image_id, case when order_index = f then t when order_index = t then f else order_index end as new_index
  from image_pages left join s using (project_id)""")
def _w15b(t):
    moves = t.image_pages.groupBy("project_id").agg(F.max("image_id").alias("image_id"), F.min("order_index").alias("target_index"))
    return O.move_page(t.image_pages, moves)


@query("w15_append_pages", """
  select e.user_id as project_id, event_id as seq, coalesce(mx, -1) + row_number() over (partition by e.user_id order by event_id) as order_index
  from events_log e left join (select project_id, max(order_index) mx from image_pages group by 1) m on e.user_id = m.project_id""")
def _w15c(t):
    return O.append_pages(t.image_pages, t.events_log.selectExpr("user_id as project_id", "event_id as seq"))


@query("w16_latest_per", """select user_id, event_type, max(event_id) as event_id, arg_max(seconds, event_id) as seconds from events_log group by 1, 2""")
def _w16(t):
    return O.latest_per(t.events_log.select("user_id", "event_type", "event_id", "seconds"), ["user_id", "event_type"], ["event_id"])


@query("w17_share_gaps", """
  with b as (select image_id, region_id, y as lo, y + h as hi from text_regions)
  select a.image_id as parent_id, a.region_id as line_id,
    greatest(0, lo - 4, (coalesce((select max(o.hi) from b o where o.image_id = a.image_id and o.hi <= a.lo), -10000) + lo) / 2) as low,
    least(1400, hi + 4, (coalesce((select min(o.lo) from b o where o.image_id = a.image_id and o.lo >= a.hi), 10000) + hi) / 2) as high from b a""")
def _w17(t):
    boxes = t.text_regions.selectExpr("image_id as parent_id", "region_id as line_id", "y", "h")
    return O.share_gaps(boxes, t.image_pages.selectExpr("image_id as parent_id", "0 as y", "height as h"), 4)


_MASKLOG = ["user_id as project_id", "event_id as entry_id", "event_id % 7 <> 0 as applied", "k % 13 <> 0 as fits", "k * k * 2000 as cost"]


@query("w18_mask_undo_chain", f"""
  with e as (select {', '.join(_MASKLOG)} from events_log),
  n as (select *, row_number() over (partition by project_id order by entry_id desc) step from e where applied),
  s as (select *, max(case when fits then 0 else 1 end) over o br, cast(sum(cost) over o as bigint) spent from n where step <= 100
    window o as (partition by project_id order by step))
  select project_id, entry_id, step, spent from s where br = 0 and spent <= 64000000""")
def _w18(t):
    return O.mask_undo_chain(t.events_log.selectExpr(*_MASKLOG), False).withColumn("step", _c("step").cast("bigint"))


@query("w19_revision_list", """select user_id as region_id, ts_us as created_us, event_id as revision_id from events_log""")
def _w19(t):
    return O.revision_list(t.events_log.selectExpr("user_id as region_id", "ts_us as created_us", "event_id as revision_id"))


_FIELDS = ["x", "y", "w", "h", "source_text", "translated_text", "locked", "visible", "font_size", "rotation", "bubble_id", "orientation"]


@query("w19_restore_revision", """
  select region_id, 'restored' as kind, case when overflow then x + 7 else x end as x, case when overflow then 'older' else source_text end as source_text from text_regions
  union all select region_id, 'restore_checkpoint', x, source_text from text_regions where overflow""")
def _w19b(t):
    r = t.text_regions
    chosen = r.where("overflow").select("region_id", *[_c(f) if f not in ("x", "source_text") else
                                                       (_c("x") + 7 if f == "x" else F.lit("older")).alias(f) for f in _FIELDS])
    restored, saved = O.restore_revision(r, chosen, _FIELDS)
    return restored.select("region_id", F.lit("restored").alias("kind"), "x", "source_text").union(
        saved.select("region_id", "action", "x", "source_text"))
