"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to many small buckets by hash.  How many rows of each bucket go
to each shard is drawn exactly: the matrix row of a bucket is a multivariate
hypergeometric draw from what is left of the shards' sizes, so every
arrangement of the rows is equally likely and every shard gets its exact size.
Inside a bucket a seeded random order decides which rows go where; after the
exchange each shard is permuted anew to number its slots.  The driver sees one
count per bucket and shard (their number is bounded), never a row.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket aimed at, and the most buckets (what bounds the matrix).
BUCKET_ROWS = 20_000
MAX_BUCKETS = 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without return from ``good + bad`` are good."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def mass(k: int) -> float:
        return math.exp(log_choose(good, k) + log_choose(bad, n - k) - log_choose(good + bad, n))

    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    u = rng.random() - mass(mode)
    if u <= 0:
        return mode
    down, up = mode, mode
    p_down = p_up = mass(mode)
    while down > low or up < high:
        if up < high:  # the next value above, from its neighbour's mass
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each bucket to each shard; shard totals differ by one at most."""
    rng = random.Random(seed)
    total = sum(sizes)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for size in sizes:
        row, open_rows, need = [], sum(left), size
        for room in left:
            k = hypergeometric(rng, room, open_rows - room, need) if need else 0
            row.append(k)
            open_rows -= room
            need -= k
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int = 8, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within a shard).

    Shard sizes differ by at most one row.  ``keys`` identify a row for the
    random orders; rows equal in all keys are told apart by their order alone
    and may swap places.  Nulls are values like others, equal texts are dealt
    independently, an empty table gives an empty result, and columns named
    ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    total = rows.count()
    buckets = min(MAX_BUCKETS, max(1, -(-total // BUCKET_ROWS)))
    # copies of a key spread as well: their place in the bucket is random, and a bucket is only a starting point
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int"))
    counted = {r[0]: r[1] for r in bucketed.groupBy("_bucket").count().collect()}
    matrix = communication_matrix([counted.get(b, 0) for b in range(buckets)], shards, seed)
    bounds = []
    for b, row in enumerate(matrix):
        at = 0
        for shard, n in enumerate(row):
            bounds.append((b, shard, at, at + n))
            at += n
    plan = rows.sparkSession.createDataFrame(bounds, "_b int, shard int, _from long, _to long").where("_from < _to")
    plan = plan.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_to", "shard"))).alias("_cuts"))
    first = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    local = bucketed.withColumn("_place", F.row_number().over(first) - 1)
    sent = (local.join(plan, local["_bucket"] == plan["_b"])
            .withColumn("shard", F.filter("_cuts", lambda c: c["_to"] > F.col("_place"))[0]["shard"])
            .drop("_cuts", "_b", "_bucket", "_place"))
    # the second permutation: a random key whose top bits cut a shard into cells of bounded size
    mixed = sent.withColumn("_mix", F.xxhash64(F.lit(seed + 2), *keys))
    mixed = mixed.withColumn("_cell", F.pmod(F.shiftrightunsigned("_mix", 32), F.lit(buckets)).cast("int"))
    cells = mixed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_mix", *keys)
    return (mixed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "_cell"])
            .withColumn("slot", (F.col("_rank") + F.col("_offset")).cast("long"))
            .select(*rows.columns, "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus one, null: one), ``text_crc32``, ``shard`` and ``slot``."""
    content = F.coalesce(docs[text], F.lit(""))
    sized = docs.drop("size", "text_crc32").withColumn(
        "size", (F.octet_length(content) + 1).cast("long")).withColumn("text_crc32", F.crc32(content))
    return shuffle_into_shards(sized, [id, "text_crc32", "size"], shards, seed)
