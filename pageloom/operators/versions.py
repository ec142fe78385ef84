"""Content versions of pages, texts and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.core.canon import canonical, fingerprint, multiset_digest

VOLATILE = ("status", "stage", "updated_us")


def row_fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, fingerprint(df.columns).alias("fingerprint"))


def page_version(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Changes whenever the page (volatile fields aside) or any region row changes."""
    inner = regions.select("image_id", fingerprint(regions.columns).alias("_f"))
    content = inner.groupBy("image_id").agg(multiset_digest(F.col("_f")).alias("_regions"))
    stable = [c for c in pages.columns if c not in VOLATILE]
    own = pages.select("image_id", canonical(stable).alias("_page"))
    return own.join(content, "image_id", "left").select(
        "image_id", F.sha2(F.concat_ws("|", "_page", F.coalesce("_regions", F.lit("0"))), 256).alias("version"))


def group_version(df: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """One digest per key over the named columns of its rows, in any order."""
    return df.select(key, fingerprint(columns).alias("_f")).groupBy(key).agg(
        F.sha2(multiset_digest(F.col("_f")), 256).alias(name))
