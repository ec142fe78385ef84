"""Canonical row text and content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(columns: Sequence[str], rename: dict[str, str] | None = None) -> Column:
    """JSON text with sorted keys, no spaces, nulls kept."""
    rename = rename or {}
    fields = sorted((rename.get(c, c), c) for c in columns)
    return F.to_json(F.struct(*[F.col(c).alias(k) for k, c in fields]), {"ignoreNullFields": "false"})


def fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(canonical(columns), 256)


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")


def multiset_digest(digest: Column) -> Column:
    """Aggregate: an order-free digest of a group of sha256 hex strings.

    Lanes of each digest are summed, so partial aggregates merge on the map
    side and no group is ever gathered into a list.
    """
    parts = [F.coalesce(F.sum(_lane(digest, at).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
             for at in (1, 16, 31)]
    return F.concat_ws(":", F.count(digest).cast("string"), *parts)
