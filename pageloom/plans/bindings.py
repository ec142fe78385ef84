"""Logical tables over the given parquet tables.

Each logical table is one list of column expressions, written in the SQL both
Spark and DuckDB accept, so the Spark binding and its checking twin cannot
drift apart.  Where the dialects differ the expression is a (spark, duckdb)
pair.  Bindings only derive columns: no rows are dropped unless the logical
table is itself a role (for example panels).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

Expr = str | tuple[str, str]


def _us(column: str) -> Expr:
    return (f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))",
            f"epoch_us({column})")


def _num(kind: str) -> Expr:
    return (f"cast(get_json_object(props, '$.{kind}') as bigint)",
            f"cast(json_extract_string(props, '$.{kind}') as bigint)")


_CENTS = "cast(floor(l_extendedprice * 100 + 0.5) as bigint)"
_TAX = "cast(floor(l_tax * 100 + 0.5) as bigint)"
_W = "(40 + 3 * cast(l_quantity as bigint))"
_H = "(30 + l_partkey % 90)"
_PARTS = ("l_partkey", "l_suppkey", "l_linenumber", "cast(l_quantity as bigint)", _CENTS, "cast(floor(l_discount * 100 + 0.5) as bigint)", _TAX,
          "(ascii(l_returnflag) * 256 + ascii(l_linestatus))", "(year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate))")


def _lane(weights: tuple[int, ...]) -> str:
    """A 31-bit hash of the row: integer arithmetic only, so it stays in generated code."""
    return "((" + " + ".join(f"{p} * cast({w} as bigint)" for p, w in zip(_PARTS, weights)) + ") % 2147483647)"


# A region is identified by its content within its page.
_REGION_ID = (f"{_lane((7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121, 982451653))} * 2147483648 + "
              f"{_lane((15487469, 32452867, 49979693, 67867979, 7927, 86028157, 982451707, 104743, 1299721))}")

_BOX = {
    "image_id": "l_orderkey",
    "region_id": _REGION_ID,
    "x": "l_partkey % 800",
    "y": "(l_suppkey * 13) % 1200",
}

LOGICAL: dict[str, tuple[str, dict[str, Expr], str | None]] = {
    "projects": ("customer", {
        "project_id": "c_custkey",
        "name": "c_name",
        "language_key": "c_nationkey",
        "segment": "c_mktsegment",
        "updated_us": "cast(round(c_acctbal * 100) as bigint) * 1000000",
    }, None),
    "image_pages": ("orders", {
        "image_id": "o_orderkey",
        "project_id": "o_custkey",
        "order_index": "o_orderkey",
        "width": "cast(1000 as bigint)",
        "height": "cast(1400 as bigint)",
        "status": "case o_orderstatus when 'O' then 'OCR_DONE' when 'F' then 'FAILED' else 'UPLOADED' end",
        "stage": "case o_orderstatus when 'O' then 'OCR' when 'F' then 'TRANSLATION' else null end",
        "exempt": "o_orderpriority = '5-LOW' and o_orderstatus = 'P'",
        "original_path": "concat('original/', o_orderkey, '.png')",
        "clean_path": "case when o_orderpriority = '1-URGENT' then null else concat('clean/', o_orderkey, '.png') end",
        "rendered_path": "case when o_orderstatus = 'F' then null else concat('rendered/', o_orderkey, '.png') end",
        "layer_path": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then null else concat('layer/', o_orderkey, '.png') end",
        "updated_us": _us("o_orderdate"),
    }, None),
    "text_regions": ("lineitem", {
        **_BOX,
        "reading_order": "cast(l_linenumber as bigint)",
        "w": _W, "h": _H,
        "label": "case l_linenumber when 1 then 'panel' when 2 then 'bubble' when 3 then 'onomatopoeia' else 'text' end",
        "confidence": "cast(floor(l_discount * 100 + 0.5) as double) / cast(10 as double)",
        "locked": "l_returnflag = 'R'",
        "vertical": "l_linestatus = 'F'",
        "orientation": "case when l_linestatus = 'F' then 'vertical' else 'horizontal' end",
        "source_text": f"case {_TAX} when 0 then '' when 1 then ' ​' when 2 then concat('caf� ', l_partkey) "
                       f"when 3 then 'aaaaaaaaaaaaaaaa' else concat('line ', l_partkey) end",
        "translated_text": f"case {_CENTS} % 7 when 0 then '' when 1 then '  ' else concat('text ', l_suppkey) end",
        "font_size": "6 + l_partkey % 20",
        "visible": f"{_CENTS} % 11 <> 0",
        "confidence_available": "l_suppkey % 9 <> 0",
        "generation_truncated": f"{_CENTS} % 13 = 0",
        "empty_chunks": f"case when {_CENTS} % 17 = 0 then cast(2 as bigint) else cast(0 as bigint) end",
        "geometry_stale": f"{_CENTS} % 19 = 0",
        "translation_fallback": f"{_CENTS} % 5 = 0",
        "overflow": f"{_CENTS} % 23 = 0",
        "layout_warning": f"{_CENTS} % 29 = 0",
        "mask_pixels": f"case when {_CENTS} % 31 = 0 then null when {_CENTS} % 31 = 1 then 0 else {_W} * {_H} end",
        "mask_method": f"case when {_TAX} = 4 then 'manual_mask' else 'segmentation' end",
        "mask_integrity": f"case {_CENTS} % 6 when 0 then 'partial' when 1 then 'uncertain' else 'complete' end",
        "constraint_status": "case l_partkey % 5 when 0 then 'fallback' when 1 then 'skipped' when 2 then 'partial' "
                             "when 3 then 'applied' else null end",
        "constraint_reason": "case when l_suppkey % 2 = 0 then 'balloon_assignment_unassigned' else 'none' end",
        "outside_pixels": "greatest(0, l_suppkey % 5 - 2)",
        "repair_status": f"case {_CENTS} % 8 when 0 then 'residual' when 1 then 'uncertain' when 2 then 'unavailable' "
                         "else 'passed' end",
        "repair_outside_pixels": "l_partkey % 3",
        "source_orientation": "case when l_suppkey % 10 = 0 then null when l_partkey % 2 = 0 then 'vertical' "
                              "else 'horizontal' end",
        "rotation": "(l_partkey % 4) * 30",
        "bubble_id": "case when l_suppkey % 3 = 0 then null else concat('bubble-', l_suppkey) end",
        "assignment_status": "case when l_suppkey % 3 = 0 then 'unassigned' else 'assigned' end",
        "role_label": "case l_partkey % 3 when 0 then 'free_text' when 1 then 'dialogue' else 'unknown' end",
        "renderer_version": "5 + l_partkey % 2",
        "updated_us": _us("l_shipdate"),
    }, None),
    "panels": ("lineitem", {**_BOX, "w": f"4 * {_W}", "h": f"4 * {_H}", "label": "'panel'"}, "l_linenumber = 1"),
    "bubbles": ("lineitem", {**_BOX, "w": f"2 * {_W}", "h": f"2 * {_H}", "label": "'bubble'"}, "l_linenumber = 2"),
    "lettering": ("lineitem", {**_BOX, "w": _W, "h": _H, "label": "'text'",
                               "confidence": "cast(floor(l_discount * 100 + 0.5) as double) / cast(10 as double)"}, "l_linenumber > 2"),
    "processing_tasks": ("orders", {
        "task_id": "o_orderkey",
        "batch_id": "o_custkey",
        "image_id": "o_orderkey",
        "status": "case when o_orderstatus = 'O' then case o_orderpriority when '1-URGENT' then 'RUNNING' "
                  "when '2-HIGH' then 'QUEUED' when '3-MEDIUM' then 'PAUSED' when '4-NOT SPECIFIED' then 'CANCELLING' "
                  "else 'QUEUED' end when o_orderstatus = 'F' then case when o_orderpriority = '5-LOW' then 'CANCELLED' "
                  "else 'FAILED' end else 'COMPLETED' end",
        "generation": "o_orderkey % 3",
        "waiting_reason": "case when o_orderpriority = '2-HIGH' then 'previous page' else null end",
        "created_us": _us("o_orderdate"),
        "updated_us": f"({_us('o_orderdate')[0]}) + (o_orderkey % 600) * 1000000",
    }, None),
    "events_log": ("events", {
        "event_id": "event_id",
        "ts_us": _us("ts"),
        "user_id": "user_id",
        "event_type": "event_type",
        "seconds": "value",
        "centis": "cast(floor(value * 100 + 0.5) as bigint)",
        "k": _num("k"),
        "props": "props",
    }, None),
    "page_texts": ("conversations", {
        "image_id": "conv_id", "reading_order": "turn", "role": "role", "text": "text"}, None),
    "source_texts": ("documents", {
        "doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}, None),
    "model_configs": ("part", {
        "model_id": "p_partkey", "kind": "p_brand", "provider": "p_type", "name": "p_name",
        "is_default": "p_size % 2 = 0", "enabled": "p_size % 5 <> 0", "updated": "p_partkey"}, None),
    "review_pages": ("orders", {
        "run_id": "o_custkey",
        "image_id": "o_orderkey",
        "reviewed_version": "o_orderkey % 3",
        "current_version": "o_orderkey % 2",
        "outcome": "case substr(o_orderpriority, 1, 1) when '1' then 'passed' when '2' then 'issues' "
                   "when '3' then 'unverified' when '4' then null else 'issues' end",
        "deliver_with_issues": "substr(o_orderpriority, 1, 1) = '5'",
        "correction_open": "o_orderstatus = 'P'",
        "lease_expires_us": f"({_us('o_orderdate')[0]}) + 900000000",
        "claimed_us": _us("o_orderdate"),
        "reviewed_us": f"({_us('o_orderdate')[0]}) + (o_orderkey % 900 - 30) * 1000000",
        "worker": "concat('worker-', o_custkey % 7)",
    }, None),
    "review_issues": ("lineitem", {
        "image_id": "l_orderkey",
        "issue_id": _REGION_ID,
        "category": "case l_returnflag when 'A' then 'source' when 'N' then 'translation' else 'repair' end",
        "status": "case l_linestatus when 'O' then 'open' else 'resolved' end",
        "issue_version": "l_partkey % 3",
    }, None),
    "asset_files": ("documents", {
        "file_id": "doc_id", "project_id": "doc_id % 50",
        "path": "concat('history/', source, '/', doc_id, '.png')",
        "bytes": "n_chars", "sha": ("sha2(text, 256)", "sha256(text)"),
        "age_minutes": "n_chars % 60",
    }, None),
    "asset_references": ("labels", {"file_id": "doc_id"}, None),
}

# Timestamps that add seconds to a base need their own DuckDB spelling.
for _table, _column, _tail in (("processing_tasks", "updated_us", "(o_orderkey % 600) * 1000000"),
                               ("review_pages", "lease_expires_us", "900000000"),
                               ("review_pages", "reviewed_us", "(o_orderkey % 900 - 30) * 1000000")):
    _base = _us("o_orderdate")
    LOGICAL[_table][1][_column] = (f"{_base[0]} + {_tail}", f"{_base[1]} + {_tail}")


class Tables:
    """Lazy access to the physical and logical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in LOGICAL:
            raise AttributeError(name)
        source, columns, where = LOGICAL[name]
        df = self.raw(source)
        if where:
            df = df.where(where)
        return df.selectExpr(*[f"{e if isinstance(e, str) else e[0]} as {n}" for n, e in columns.items()])


def _duck_cte(name: str) -> str:
    source, columns, where = LOGICAL[name]
    picks = ", ".join(f"{e if isinstance(e, str) else e[1]} as {n}" for n, e in columns.items())
    return f"{name} as (select {picks} from {source}{' where ' + where if where else ''})"


def duck_sql(body: str) -> str:
    """Prefix a checking query with the logical tables it names."""
    used = [n for n in LOGICAL if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(_duck_cte(n) for n in used)
    body = body.strip()
    if not ctes:
        return body
    recursive = ""
    if body.lower().startswith("with recursive "):
        recursive, body = "recursive ", "with " + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return f"with {recursive}{ctes}, {body[5:]}"
    return f"with {ctes} {body}"
