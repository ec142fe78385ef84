"""F-01..F-38 bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import regions as R
from pageloom.functions import replies as P
from pageloom.functions import text as X
from pageloom.plans.filters import NOW_US, VISIBLE
from pageloom.plans.registry import query

_c = F.col
_ODD = "case doc_id % 9 when 0 then '' when 1 then ' ​́' when 2 then concat('﻿', substr(text, 1, 3)) else text end"


@query("f01_has_text", f"select doc_id, regexp_matches({_ODD}, '{VISIBLE}') as has_text from source_texts")
def _f01(t):
    return t.source_texts.select("doc_id", X.has_text(F.expr(_ODD)).alias("has_text"))


@query("f02_ocr_hints")
def _f02(t):
    texts = F.when(_c("doc_id") % 5 == 0, F.concat("text", F.repeat(F.lit("ha "), F.lit(9)))).when(
        _c("doc_id") % 7 == 0, F.concat("text", F.lit("�"))).otherwise(_c("text"))
    return t.source_texts.select("doc_id", F.array_join(X.ocr_hints(texts), ",").alias("hints"))


@query("f03_graphemes")
def _f03(t):
    return t.source_texts.select("doc_id", F.size(X.graphemes(_c("text"))).alias("graphemes"))


@query("f04_word_count")
def _f04(t):
    return t.source_texts.select("doc_id", X.word_count(_c("text")).alias("words"), X.chunk_count(_c("text")).alias("chunks"))


_QUOTE = lambda s: "(" + ", ".join("'" + ("''" if ch == "'" else ch) + "'" for ch in s) + ")"
_DW = lambda c: (f"(regexp_matches({c}, '^[''_’A-Za-z0-9]') or ({c} >= 'À' and {c} < '⺀' and regexp_matches({c}, '^[\\p{{L}}\\p{{N}}]')))")


@query("f05_can_break", f"""
  with p as (select doc_id, substr(text, 1 + doc_id % 40, 1) l, substr(text, 2 + doc_id % 40, 1) r from source_texts)
  select doc_id, l, r, not (l in {_QUOTE(X.OPENING)} or r in {_QUOTE(X.CLOSING)} or l = ' ' or r = ' ' or ({_DW('l')} and {_DW('r')})
    or (l in ('.', ',', ':') and regexp_matches(r, '^[0-9]+$')) or (l = r and l in ('…', '—'))) as can_break from p""")
def _f05(t):
    at = (_c("doc_id") % 40).cast("int")
    pairs = t.source_texts.select("doc_id", F.substring("text", at + 1, F.lit(1)).alias("l"), F.substring("text", at + 2, F.lit(1)).alias("r"))
    return pairs.withColumn("can_break", X.can_break(_c("l"), _c("r")))


@query("f06_wrap")
def _f06(t):
    return t.source_texts.select("doc_id", F.posexplode(X.wrap(_c("text"), 24)).alias("line", "line_text"))


@query("f07_text_chunks")
def _f07(t):
    return t.source_texts.select("doc_id", F.posexplode(X.text_chunks(_c("text"), 4000)).alias("chunk", "chunk_text"))


_MID = "cast(floor(length(text) / 2) as bigint)"


@query("f08_split_text", f"""
  with c as (select doc_id, text, {_MID} + length(regexp_extract(substr(text, {_MID} + 1, 12), '^[^{X.SPLIT_MARKS}]*[{X.SPLIT_MARKS}]')) as cut from source_texts)
  select doc_id, md5(regexp_replace(substr(text, 1, cut), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) as a,
    md5(regexp_replace(substr(text, cut + 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) as b from c""")
def _f08(t):
    halves = X.split_text(_c("text"))
    return t.source_texts.select("doc_id", halves.alias("h")).select("doc_id", F.md5("h.first").alias("a"), F.md5("h.second").alias("b"))


_NAME = "concat(regexp_replace(url, '[^A-Za-z0-9]+', '_'{g}), page_id * 7, '.PNG')"
_NAME_S, _NAME_D = _NAME.format(g=""), _NAME.format(g=", 'g'")


@query("f09_natural_key", f"""select page_id, array_to_string(list_transform(regexp_extract_all(
   case when regexp_matches({_NAME_D}, '^[0-9]') then '~' else '' end || lower({_NAME_D}), '([0-9]+|[^0-9]+)'),
   lambda p: case when regexp_matches(p, '^[0-9]') then concat('1', lpad(cast(length(regexp_replace(p, '^0+(.)', '\\1')) as varchar), 10, '0'),
     regexp_replace(p, '^0+(.)', '\\1')) else concat('0', replace(p, '~', '')) end), '|') as natural_key from pages""")
def _f09(t):
    return t.raw("pages").select("page_id", F.array_join(X.natural_key(F.expr(_NAME_S)), "|").alias("natural_key"))


_MEMBER = "case page_id % 6 when 0 then concat('/', url) when 1 then concat('a/../', page_id) when 2 then concat('a\\\\b', page_id) when 3 then concat('c..d/', page_id) when 4 then url else '' end"
_MEMBER_D = _MEMBER.replace("\\\\", "\\")


@query("f10_safe_member", f"""with m as (select page_id, replace({_MEMBER_D}, '\\', '/') n from pages)
  select page_id, length(n) > 0 and not starts_with(n, '/') and not contains(n, ':') and not regexp_matches(n, '(^|/)\\.\\.(/|$)') as safe from m""")
def _f10(t):
    return t.raw("pages").select("page_id", X.safe_member(F.expr(_MEMBER)).alias("safe"))


@query("f11_safe_filename", """with n as (select page_id, regexp_replace(regexp_replace(regexp_extract(case url when '' then 'page' else url end, '([^/]*)/*$', 1),
  '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') n from pages) select page_id, case n when '' then 'page' else n end as name from n""")
def _f11(t):
    return t.raw("pages").select("page_id", X.safe_filename(_c("url"), "page").alias("name"))


_BOUND = "case doc_id % 4 when 0 then null when 1 then '   ' else concat('  ', substr(text, 1, 300)) end"


@query("f12_bounded_text", f"""with t as (select doc_id, trim(coalesce({_BOUND}, 'untitled')) k from source_texts)
  select doc_id, substr(case k when '' then 'untitled' else k end, 1, 200) as bounded from t""")
def _f12(t):
    return t.source_texts.select("doc_id", X.bounded_text(F.expr(_BOUND), "untitled", 200).alias("bounded"))


@query("f13_unique_key")
def _f13(t):
    return R.unique_key(t.text_regions.select("image_id", _c("region_id").alias("seq"), F.format_string("R%03d", "reading_order").alias("region_key")))


_CODE = "case doc_id % 8 when 0 then 'JP' when 1 then ' zh_TW ' when 2 then 'zh-Hans' when 3 then 'auto' when 4 then 'not a code' when 5 then 'pt_BR' when 6 then 'ko-KR' else lang end"
_ALIASES = " ".join(f"when '{a}' then '{b}'" for a, b in X.LANGUAGE_ALIASES.items())


@query("f14_language_code", f"""with c as (select doc_id, lower(replace(trim({_CODE}), '_', '-')) c from source_texts)
  select doc_id, case when regexp_full_match(c, '[a-z]{{2,3}}(-[a-z0-9]{{2,8}})*|auto') and c <> 'auto' then case c {_ALIASES} else c end end as code from c""")
def _f14(t):
    return t.source_texts.select("doc_id", X.language_code(F.expr(_CODE), target=True).alias("code"))


@query("f15_vertical_forms", f"select doc_id, md5(translate(text, '{X.VERTICAL_FROM}', '{X.VERTICAL_TO}')) as digest from source_texts")
def _f15(t):
    return t.source_texts.select("doc_id", F.md5(X.vertical_forms(_c("text"))).alias("digest"))


@query("f16_parse_reply")
def _f16(t):
    pairs = F.to_json(F.create_map(F.concat(F.lit("["), "doc_id", F.lit("]")), _c("text"), F.lit("x"), _c("lang")))
    reply = (F.when(_c("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), pairs, F.lit("\n```")))
             .when(_c("doc_id") % 5 == 1, F.concat(F.lit('{"translations": '), pairs, F.lit("}")))
             .when(_c("doc_id") % 5 == 2, F.expr("substr(_p, 1, length(_p) - 4)")).otherwise(F.concat(pairs, F.lit(""))))
    texts = t.source_texts.withColumn("_p", pairs)
    return texts.select("doc_id", P.parse_reply(reply).alias("r")).select(
        "doc_id", F.size("r.texts").alias("entries"), "r.error")


@query("f17_extract_path", "select event_id, trim(json_extract_string(props, '$.k')) as value, concat(user_id, chr(10), event_type) as many from events_log")
def _f17(t):
    wrapped = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), _c("user_id").cast("string")).alias("b")), F.struct(_c("event_type").alias("b"))).alias("a")))
    return t.events_log.select("event_id", P.extract_path(_c("props"), "k").alias("value"), P.extract_path(wrapped, "a.*.b").alias("many"))


_RETRY = "case event_id % 5 when 0 then cast(k as varchar(10)) when 1 then 'Mon, 01 Jan 2024 00:01:40 GMT' when 2 then 'soon' when 3 then '-4' else null end"


@query("f18_retry_after", f"""select event_id, case event_id % 5 when 0 then cast(k as double) when 1 then greatest(0.0, (1704067300000000 - ts_us) / 1e6) when 3 then 0.0 end as seconds from events_log""")
def _f18(t):
    return t.events_log.select("event_id", X.retry_after(F.expr(_RETRY), _c("ts_us")).alias("seconds"))


def _quad(shift: str = "font_size"):
    x, y, w, h, d = (_c(n).cast("double") for n in ("x", "y", "w", "h", shift))
    return F.array(G.point(x, y), G.point(x + w, y + d), G.point(x + w + d, y + h), G.point(x - d, y + h - d))


_XS = ["x", "x + w", "x + w + font_size", "x - font_size"]
_YS = ["y", "y + font_size", "y + h", "y + h - font_size"]


@query("f19_polygon_to_bbox", f"""select region_id, cast(least({', '.join(_XS)}) as double) as bx, cast(least({', '.join(_YS)}) as double) as "by",
  cast(greatest({', '.join(_XS)}) - least({', '.join(_XS)}) as double) as bw, cast(greatest({', '.join(_YS)}) - least({', '.join(_YS)}) as double) as bh,
  concat(x, ' ', y, ',', x + w, ' ', y, ',', x + w, ' ', y + h, ',', x, ' ', y + h) as corners from text_regions""")
def _f19(t):
    corners = G.box_to_polygon(_c("x"), _c("y"), _c("w"), _c("h"))
    text = F.array_join(F.transform(corners, lambda v: F.concat_ws(" ", v["x"].cast("bigint").cast("string"), v["y"].cast("bigint").cast("string"))), ",")
    return t.text_regions.select("region_id", G.polygon_to_box(_quad()).alias("b"), text.alias("corners")).select(
        "region_id", _c("b.x").alias("bx"), _c("b.y").alias("by"), _c("b.w").alias("bw"), _c("b.h").alias("bh"), "corners")


@query("f20_intersection_area", """select region_id, greatest(0, least(x + w, 500) - greatest(x, 200)) * greatest(0, least(y + h, 900) - greatest(y, 300)) as inter from text_regions""")
def _f20(t):
    from pageloom.core.grid import intersection
    cols = [_c(n).alias("a_" + n) for n in ("x", "y", "w", "h")]
    fixed = [F.lit(v).cast("bigint").alias("b_" + n) for n, v in (("x", 200), ("y", 300), ("w", 300), ("h", 600))]
    return t.text_regions.select("region_id", *cols, *fixed).select("region_id", intersection("a_", "b_").alias("inter"))


_SHOE = " + ".join(f"(({_XS[i]}) * ({_YS[(i + 1) % 4]}) - ({_XS[(i + 1) % 4]}) * ({_YS[i]}))" for i in range(4))


@query("f21_polygon_area", f"select region_id, abs({_SHOE}) / 2.0 as area from text_regions".replace("/ 2.0", "/ 2"))
def _f21(t):
    return t.text_regions.select("region_id", G.polygon_area(_quad()).alias("area"))


def _bow(t):
    """Quads by kind: plain, crossed, repeated vertex, flat, too short."""
    x, y, w, h = (_c(n).cast("double") for n in ("x", "y", "w", "h"))
    a, b, c, d = G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h)
    kind = _c("font_size") % 5
    return t.text_regions.select("image_id", "region_id", F.when(kind == 0, F.array(a, b, c, d)).when(kind == 1, F.array(a, c, b, d)).when(
        kind == 2, F.array(a, b, b, d)).when(kind == 3, F.array(a, b, G.point(x + w / 2, y))).otherwise(F.array(a, b)).alias("polygon"))


@query("f22_valid_polygon", """select region_id, case font_size % 5 when 0 then null when 1 then case when w = h then 'degenerate' else 'degenerate' end when 2 then 'repeated_vertex'
  when 3 then 'degenerate' else 'count' end as reason from text_regions""")
def _f22(t):
    return _bow(t).select("region_id", G.invalid_reason(_c("polygon")).alias("reason"))


@query("f23_order_quad")
def _f23(t):
    p = _quad()
    turned = F.concat(F.slice(p, 3, 2), F.slice(p, 1, 2))
    corner = lambda i: F.concat_ws(" ", *[F.get("ring", F.lit(i))[k].cast("string") for k in "xy"])
    text = F.when(_c("ring").isNotNull(), F.concat_ws(",", *[corner(i) for i in range(4)]))
    return t.text_regions.select("region_id", G.order_quad(turned).alias("ring")).select("region_id", text.alias("corners"))


_ROT = lambda i: (f"round(least(greatest((x + w / 2.0) + (({_XS[i]}) - (x + w / 2.0)) * cos(radians(rotation)) - (({_YS[i]}) - (y + h / 2.0)) * sin(radians(rotation)), 0), 1000), 6)",
                  f"round(least(greatest((y + h / 2.0) + (({_XS[i]}) - (x + w / 2.0)) * sin(radians(rotation)) + (({_YS[i]}) - (y + h / 2.0)) * cos(radians(rotation)), 0), 1400), 6)")


@query("f24_rotate_polygon", "select region_id, " + ", ".join(f"{_ROT(i)[0]} as x{i}, {_ROT(i)[1]} as y{i}" for i in range(4)) + " from text_regions")
def _f24(t):
    p = G.rotate_polygon(_quad(), _c("x") + _c("w") / 2, _c("y") + _c("h") / 2, _c("rotation").cast("double"), F.lit(1000.0), F.lit(1400.0))
    return t.text_regions.select("region_id", p.alias("p")).select("region_id", *[
        F.round(F.get("p", F.lit(i))[k], 6).alias(f"{k}{i}") for i in range(4) for k in "xy"])


def _boxes(t):
    b = F.struct(*[_c(n).cast("double").alias(n) for n in ("x", "y", "w", "h")])
    shifted = F.struct((_c("x") + 5).cast("double").alias("x"), *[_c(n).cast("double").alias(n) for n in ("y", "w", "h")])
    return b, shifted


@query("f25_normalise_frames", """select region_id, cast(x as double) as x, cast(case font_size % 3 when 2 then x + 5 else x end as double) as tx, cast(w as double) as w,
   case when font_size % 7 = 3 then 'box' end as problem from text_regions""")
def _f25(t):
    b, shifted = _boxes(t)
    flat = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), F.when(_c("font_size") % 7 == 3, 0.0).otherwise(b["h"]).alias("h"))
    k = _c("font_size") % 3
    poly = G.box_to_polygon(_c("x"), _c("y"), _c("w"), _c("h"))
    has_poly = (k == 1) & (_c("font_size") % 7 != 3)
    df = t.text_regions.select("region_id", F.when(~has_poly, flat).alias("box"), F.when(has_poly, poly).alias("polygon"),
                               F.when(k == 2, shifted).alias("translated_box"), F.lit(None).cast(
                                   "array<struct<x:double,y:double>>").alias("translated_polygon"))
    return R.normalise_frames(df).select("region_id", _c("box.x").alias("x"), _c("translated_box.x").alias("tx"), _c("box.w").alias("w"), "problem")


@query("f26_padding", """with p as (select region_id, case when font_size % 3 = 0 then x / 10.0 end u, case when font_size % 2 = 0 then y / 30.0 end tp from text_regions),
   q as (select region_id, coalesce(tp, u, 3.0) top, coalesce(u, 3.0) lf from p)
  select region_id, case when top between 0 and 50 and lf between 0 and 50 then top end as top, case when top between 0 and 50 and lf between 0 and 50 then lf end as "left" from q""")
def _f26(t):
    none = F.lit(None).cast("double")
    p = R.padding(F.when(_c("font_size") % 3 == 0, _c("x") / 10.0), F.when(_c("font_size") % 2 == 0, _c("y") / 30.0), none, none, none)
    return t.text_regions.select("region_id", p.alias("p")).select("region_id", "p.top", "p.left")


@query("f27_split_bbox", """select region_id, case when w >= h then x + w / 2 else x end as x2, case when w >= h then y else y + h / 2 end as y2,
   case when w >= h then w / 2 else w end as w2, x + 12 as copy_x from text_regions""".replace("else x end", "else cast(x as double) end").replace(
       "then y else", "then cast(y as double) else").replace("else w end", "else cast(w as double) end"))
def _f27(t):
    parts = G.split_box(_c("x"), _c("y"), _c("w"), _c("h"), F.lit("auto"))
    return t.text_regions.select("region_id", F.get(parts, F.lit(1)).alias("s"), (_c("x") + 12).alias("copy_x")).select(
        "region_id", _c("s.x").alias("x2"), _c("s.y").alias("y2"), _c("s.w").alias("w2"), "copy_x")


@query("f28_aligned_frame", """select region_id, case when rotation <> 0 and font_size % 2 = 0 then cast(x as double) end as x,
   case when rotation <> 0 and font_size % 2 = 0 then cast(w as double) end as w from text_regions""")
def _f28(t):
    box = G.box_to_polygon(_c("x"), _c("y"), _c("w"), _c("h"))
    angle = _c("rotation").cast("double")
    drawn = G.rotate_polygon(F.when(_c("font_size") % 2 == 0, box).otherwise(_quad()), _c("x") + _c("w") / 2, _c("y") + _c("h") / 2, angle)
    return t.text_regions.select("region_id", drawn.alias("p"), angle.alias("a")).select(
        "region_id", G.aligned_frame(_c("p"), _c("a")).alias("f")).select("region_id", F.round("f.x", 4).alias("x"), F.round("f.w", 4).alias("w"))


_PX, _PY = "(x + font_size * 3)", "(y + font_size * 2)"
_RAY = " + ".join(f"case when (({_YS[i]}) > {_PY}) <> (({_YS[(i + 1) % 4]}) > {_PY}) and {_PX} < (({_XS[(i + 1) % 4]}) - ({_XS[i]})) * ({_PY} - ({_YS[i]})) / (({_YS[(i + 1) % 4]}) - ({_YS[i]})) + ({_XS[i]}) then 1 else 0 end" for i in range(4))
_EDGE = " or ".join(f"((({_XS[(i + 1) % 4]}) - ({_XS[i]})) * ({_PY} - ({_YS[i]})) = (({_YS[(i + 1) % 4]}) - ({_YS[i]})) * ({_PX} - ({_XS[i]})) and {_PX} between least({_XS[i]}, {_XS[(i + 1) % 4]}) and greatest({_XS[i]}, {_XS[(i + 1) % 4]}) and {_PY} between least({_YS[i]}, {_YS[(i + 1) % 4]}) and greatest({_YS[i]}, {_YS[(i + 1) % 4]}))" for i in range(4))


@query("f29_point_in_polygon", f"select region_id, ({_RAY}) % 2 = 1 or {_EDGE} as inside from text_regions")
def _f29(t):
    return t.text_regions.select("region_id", G.point_in_polygon(_quad(), F.expr(_PX).cast("double"), F.expr(_PY).cast("double")).alias("inside"))


@query("f30_rotation_rules", """
  select region_id, cast(case when visible and ((font_size % 2 = 0 and role_label = 'free_text') or (font_size % 3 = 0 and font_size % 2 = 0)) and font_size % 5 <> 0 then 0 else rotation end as double) as effective,
    cast(case when bubble_id is null and role_label = 'free_text' and label = 'text' and assignment_status = 'unassigned' and rotation <= 45 then rotation end as double) as free_angle,
    not (role_label = 'dialogue' or assignment_status = 'assigned' or overflow or locked or not visible or bubble_id is not null or rotation > 0.01) and font_size % 4 <> 0 as can_initialise from text_regions""")
def _f30(t):
    from pageloom.operators.quality import confirmed_free_text
    b, shifted = _boxes(t)
    r = t.text_regions
    poly = G.box_to_polygon(_c("x"), _c("y"), _c("w"), _c("h"))
    rot = _c("rotation").cast("double")
    df = r.withColumn("polygon", poly).withColumn("translated_polygon", F.when(_c("font_size") % 3 == 0, poly)).withColumn("box", b).withColumn(
        "translated_box", F.when(_c("font_size") % 4 == 0, shifted)).withColumn("has_rotation_source", _c("overflow")).withColumn(
        "perspective_warp", ~_c("visible"))
    eff = R.effective_rotation(rot, _c("visible"), F.when(_c("font_size") % 2 == 0, "detector").otherwise("user"), _c("role_label"),
                               F.when(_c("font_size") % 3 == 0, 2).otherwise(1), F.when(_c("font_size") % 5 == 0, rot + 1).otherwise(rot))
    sure = confirmed_free_text(_c("bubble_id"), _c("role_label"), _c("label"), _c("assignment_status"))
    return df.select("region_id", eff.alias("effective"), R.free_text_angle(sure, rot).alias("free_angle"), R.can_initialise_rotation().alias("can_initialise"))


@query("f31_auto_font_size", """select region_id, case font_size % 4 when 0 then true when 1 then false when 2 then x % 2 = 0 else true end as auto from text_regions""")
def _f31(t):
    k = _c("font_size") % 4
    explicit = F.when(k == 0, True).when(k == 1, False)
    recorded = F.when(k == 2, _c("font_size") + _c("x") % 2).cast("double")
    return t.text_regions.select("region_id", R.auto_font_size(explicit, recorded, _c("font_size").cast("double")).alias("auto"))


_LIN = lambda c: f"case when ({c}) / 255.0 <= 0.04045 then ({c}) / 255.0 / 12.92 else pow((({c}) / 255.0 + 0.055) / 1.055, 2.4) end"


@query("f32_linear_luminance", f"""select region_id, round({_LIN('x % 256')} * 0.2126 + {_LIN('y % 256')} * 0.7152 + {_LIN('w % 256')} * 0.0722, 6) as luminance from text_regions""")
def _f32(t):
    return t.text_regions.select("region_id", F.round(G.linear_luminance(_c("x") % 256, _c("y") % 256, _c("w") % 256), 6).alias("luminance"))


@query("f33_typography_patch")
def _f33(t):
    r = t.text_regions.selectExpr(
        "image_id", "region_id", "locked", "not visible as perspective_warp", "cast(0 as double) as rotation", "'a' as geometry",
        "if(font_size % 9 = 0, 'b', 'a') as evidence_geometry", "case when overflow then 'user' end as rotation_source",
        "case font_size % 4 when 0 then 'manual' when 1 then null else 'auto' end as target_state", "font_size % 2 = 0 as managed",
        "font_size % 3 = 0 as pristine", "case font_size % 5 when 0 then null when 1 then 'uncertain' when 2 then 'upright' else 'accepted' end as evidence_status",
        "2 - font_size % 11 div 10 as evidence_version", "cast(rotation as double) as angle", "font_size % 6 <> 1 as has_frame",
        "font_size % 2 = 1 as orientation_confident", "cast(null as string) as orientation_state", "orientation as evidence_orientation")
    return R.typography_patch(r)


@query("f34_region_update", """
  select region_id, cast(case font_size % 4 when 0 then x + 5 else x end as double) as x, case when font_size % 4 = 0 then null else bubble_id end as bubble_id,
    font_size % 4 = 0 or overflow as manual,
    case when font_size % 3 = 0 then (font_size % 9 = 0) when font_size % 4 = 0 then true else geometry_stale end as ocr_geometry_stale,
    case when font_size % 5 = 0 then false when font_size % 3 = 0 and (case when font_size % 9 = 0 then ' ' else 'new' end) <> source_text then trim(translated_text) <> ''
      else translation_fallback end as translation_stale,
    case when font_size % 7 = 0 then false when font_size % 4 = 0 then true else visible end as sync_pending from text_regions""")
def _f34(t):
    b, shifted = _boxes(t)
    k = _c("font_size")
    none = F.lit(None)
    poly = G.box_to_polygon(_c("x"), _c("y"), _c("w"), _c("h"))
    rows = t.text_regions.select(
        "image_id", "region_id", b.alias("box"), poly.alias("polygon"), b.alias("translated_box"), "source_text", "translated_text", "bubble_id",
        _c("rotation").cast("double").alias("rotation"), F.lit("m.png").alias("mask_path"), F.lit("i.png").alias("inpainted_path"),
        _c("overflow").alias("manual"), _c("geometry_stale").alias("ocr_geometry_stale"), _c("translation_fallback").alias("translation_stale"),
        _c("visible").alias("sync_pending"), F.lit("source_to_translated").alias("sync_direction"),
        F.when(k % 4 == 0, shifted).alias("p_box"), none.cast("array<struct<x:double,y:double>>").alias("p_polygon"),
        F.when(k % 3 == 0, F.when(k % 9 == 0, " ").otherwise("new")).alias("p_source_text"), F.when(k % 5 == 0, "typed").alias("p_translated_text"),
        none.cast("struct<x:double,y:double,w:double,h:double>").alias("p_translated_box"), F.when(k % 7 == 0, 10.0).alias("p_rotation"))
    return R.region_update(rows).select("region_id", _c("box.x").alias("x"), "bubble_id", "manual", "ocr_geometry_stale", "translation_stale", "sync_pending")


_STG = "case event_type when 'click' then 'ocr' when 'view' then 'mask' when 'error' then 'rendering' when 'signup' then 'detection' end"
_RUN = "case k % 3 when 0 then 'OCR_RUNNING' when 1 then 'RENDERING' else 'DETECTING' end"


@query("f35_stable_status", f"""with e as (select event_id, {_STG} s, {_RUN} r from events_log)
  select event_id, case when s = 'ocr' and r = 'OCR_RUNNING' then 'DETECTED' when s = 'rendering' and r = 'RENDERING' then 'INPAINTED'
    when s = 'detection' and r = 'DETECTING' then 'UPLOADED' else r end as status from e""")
def _f35(t):
    return t.events_log.select("event_id", R.stable_status_before(F.expr(_STG), F.expr(_RUN)).alias("status"))


@query("f36_lease_evidence", f"""select image_id, lease_expires_us > {NOW_US} as live, claimed_us >= {NOW_US} - 86400000000 and reviewed_version = current_version and not correction_open as fresh
  from review_pages""")
def _f36(t):
    return t.review_pages.select("image_id", R.lease_live(_c("lease_expires_us"), NOW_US).alias("live"), R.evidence_fresh(
        _c("claimed_us"), NOW_US, _c("reviewed_version"), _c("current_version"), ~_c("correction_open")).alias("fresh"))


@query("f37_crop_angle")
def _f37(t):
    k, rot = _c("font_size"), _c("rotation").cast("double")
    poly = _quad()
    df = t.text_regions.select("region_id", poly.alias("polygon"), F.when(k % 2 == 0, poly).alias("frame_polygon"), F.when(k % 3 == 0, rot).alias("frame_angle"),
                               _c("overflow").alias("manual"), (rot / 2).alias("detected_angle"), "x", "y", "w", "h", "rotation")
    moved = G.rotate_polygon(_c("polygon"), _c("x") + _c("w") / 2, _c("y") + _c("h") / 2, rot)
    step = df.withColumn("moved", moved)
    return step.select("region_id", R.source_crop_angle().alias("crop_angle"), F.round(R.carry_frame(_c("polygon"), _c("moved")), 6).alias("carried_angle"))


def _sync_rows(t):
    b, shifted = _boxes(t)
    k = _c("font_size")
    return t.text_regions.select(
        "image_id", "region_id", b.alias("box"), F.when(k % 2 == 0, shifted).otherwise(b).alias("translated_box"), (k % 3 == 0).alias("pending"),
        F.when(k % 5 == 0, "manual").alias("target_state"), F.when(k % 7 == 0, "user").alias("rotation_source"), (~_c("visible")).alias("perspective_warp"),
        "locked", _c("overflow").alias("automatic_current"), (k % 4).alias("revision"), F.lit("source_to_translated").alias("sync_direction"))


@query("f38_sync_target", """with s as (select *, font_size % 5 = 0 or font_size % 7 = 0 or not visible or locked as man from text_regions),
  c as (select *, font_size % 3 = 0 and not man and not overflow as cp from s)
  select region_id, cast(case when cp or font_size % 2 = 1 then x else x + 5 end as double) as tx, not cp and not visible as warp, font_size % 4 + case when cp then 1 else 0 end as revision,
    case when cp then 'source_to_translated' when font_size % 3 = 0 and man then 'manual_translation' else 'source_to_translated' end as direction from c""")
def _f38(t):
    return R.sync_target_from_source(_sync_rows(t)).select("region_id", _c("translated_box.x").alias("tx"), _c("perspective_warp").alias("warp"), "revision", "direction")


@query("f38_sync_source", """select region_id, cast(case when font_size % 2 = 0 then x + 5 else x end as double) as x,
  font_size % 4 + case when font_size % 2 = 0 or font_size % 3 = 0 then 1 else 0 end as revision, font_size % 2 = 0 as changed,
  case when font_size % 2 = 0 or font_size % 3 = 0 then 'translated_to_source' else 'source_to_translated' end as direction from text_regions""")
def _f38b(t):
    return R.sync_source_from_target(_sync_rows(t)).select("region_id", _c("box.x").alias("x"), "revision", "changed", "direction")
