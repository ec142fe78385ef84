"""Reading state tables, snapshots and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.sources.schemas import TABLES

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")


def read_state(spark: SparkSession, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per state table, with its declared schema."""
    return {n: spark.read.schema(TABLES[n]).parquet(f"{folder}/{n}") for n in tables or TABLES}


def read_state_jdbc(spark: SparkSession, url: str, table: str, key: str, low: str, high: str, partitions: int) -> DataFrame:
    """A state table from its relational store, read in parallel ranges of ``key``."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load())


def consistent_snapshot(spark: SparkSession, folder: str, version: str, tables: list[str]) -> dict[str, DataFrame]:
    """All tables of one immutable version folder, so that they agree with each other."""
    return {n: spark.read.parquet(f"{folder}/{version}/{n}.parquet") for n in tables}


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, bytes, modified) of every file; contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
            .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def scan_directory(files: DataFrame, root: str, suffixes=IMAGE_SUFFIXES, max_files: int = 2000, max_bytes: int = 2 << 30) -> DataFrame:
    """Page files under ``root`` with a verdict column (null = accepted).

    Hidden files and operating-system leftovers are skipped silently; a broken
    rule on any file, or on the whole set, marks the row.
    """
    c = F.col
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    inner = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit(root.rstrip("/") + "/"), F.lit(""))
    hidden = inner.rlike(r"(^|/)\.") | inner.contains("__MACOSX") | F.lower(name).isin("thumbs.db", "desktop.ini")
    kept = files.withColumn("name", name).withColumn("member", inner).where(
        ~hidden & F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*suffixes))
    folded = kept.groupBy(F.lower("member").alias("_folded")).agg(F.count(F.lit(1)).alias("_same"))
    total = kept.agg(F.count(F.lit(1)).alias("_files"), F.sum("bytes").alias("_total"))
    marked = kept.withColumn("_folded", F.lower("member")).join(folded, "_folded").join(F.broadcast(total))  # one row
    verdict = (F.when(c("member").contains(":") | ~X.safe_member(c("member")), "unsafe_path").when(F.octet_length("name") > 255, "name_too_long")
               .when(c("_same") > 1, "duplicate_path").when(c("bytes") == 0, "empty_file").when(c("_files") > max_files, "too_many_files")
               .when(c("_total") > max_bytes, "too_large"))
    return marked.select("member", "bytes", X.natural_key(c("member")).alias("sort_key"), verdict.alias("problem"))
