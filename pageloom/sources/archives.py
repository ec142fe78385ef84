"""Comic archives: member listings, import rules and page order."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.core import ranking
from pageloom.functions import text as X

MEMBERS = "archive string, member string, bytes bigint, is_dir boolean, is_link boolean, encrypted boolean"
SUFFIX = r"\.(jpg|jpeg|png|webp)$"


def member_rows(archive: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as listing:
        for info in listing.infolist():
            link = (info.external_attr >> 28) == 0xA
            yield archive, info.filename, info.file_size, info.is_dir(), link, bool(info.flag_bits & 1)


def list_archive_members(archives: DataFrame) -> DataFrame:
    """Rows of each ZIP/CBZ listing; ``archives``: path, content."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in zip(batch.path, batch.content) for r in member_rows(path, bytes(content))]
            yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "is_dir", "is_link", "encrypted"])
    return archives.select("path", "content").mapInPandas(run, MEMBERS)


def validate_members(members: DataFrame, max_pages: int = 2000, max_bytes: int = 2 << 30) -> DataFrame:
    """(archive, problem): the first broken rule of each archive, null when importable."""
    c = F.col
    path = F.replace("member", F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    page = (~c("is_dir") & ~path.rlike(r"(^|/)__MACOSX(/|$)") & ~name.startswith(".") & F.lower(name).rlike(SUFFIX))
    m = members.withColumn("_name", name).withColumn("_page", page).withColumn("_folded", F.lower(path))
    twice = (m.where("_page").groupBy("archive", "_folded").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select("archive", F.lit(True).alias("_twice")).distinct())
    facts = m.groupBy("archive").agg(
        F.count(F.lit(1)).alias("_entries"), F.bool_or(~X.safe_member(c("member"))).alias("_unsafe"), F.bool_or("is_link").alias("_link"),
        F.bool_or("encrypted").alias("_secret"), F.sum(F.when(c("is_dir"), 0).otherwise(c("bytes"))).alias("_bytes"),
        F.count_if("_page").alias("pages"), F.bool_or(c("_page") & (F.length("_name") > 255)).alias("_long"))
    return facts.join(twice, "archive", "left").select("archive", "pages", (
        F.when(c("_entries") > max_pages * 10, "too_many_entries").when(c("_unsafe"), "unsafe_path").when(c("_link"), "symlink")
        .when(c("_secret"), "encrypted").when(c("_bytes") > max_bytes, "too_large").when(c("_twice"), "duplicate_path")
        .when(c("_long"), "name_too_long").when(c("pages") > max_pages, "too_many_pages").when(c("pages") == 0, "no_pages")).alias("problem"))


def pages_from_members(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Ordered pages of each archive, continuing after the project's last order_index.

    ``members``: project_id, archive, member; a natural key's first piece serves as the ranking bucket.
    """
    keyed = members.withColumn("sort_key", X.natural_key(F.replace("member", F.lit("\\"), F.lit("/"))))
    placed = ranking.ranked(keyed, ["project_id"], [F.col("sort_key"), F.col("member")], F.get("sort_key", F.lit(0)))
    last = existing.groupBy("project_id").agg(F.max("order_index").alias("_last"))
    return placed.join(last, "project_id", "left").select(
        "project_id", "member", (F.coalesce("_last", F.lit(-1)) + F.col("position")).alias("order_index"))
