import random
import zlib
from collections import Counter
from math import comb

from pageloom.llm import sharding
from tests.conftest import SMALL


def test_hypergeometric_law():
    rng, good, bad, n, runs = random.Random(4), 7, 9, 6, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(runs))
    for k in range(n + 1):
        p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
        assert abs(seen[k] / runs - p) < 4 * (p * (1 - p) / runs) ** 0.5 + 1e-3
    for g, b, k in ((0, 5, 3), (5, 0, 3), (10**9, 10**10, 10**6), (3, 3, 6)):
        assert max(0, k - b) <= sharding.hypergeometric(rng, g, b, k) <= min(g, k)


def test_matrix_margins():
    sizes = [5, 0, 17, 3, 40]
    matrix = sharding.communication_matrix(sizes, 8, 3)
    assert [sum(r) for r in matrix] == sizes
    totals = [sum(c) for c in zip(*matrix)]
    assert sorted(totals) == [8] * 7 + [9]


def check(rows, n, shards):
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


def test_rows_law_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = [(i, f"text {i % 7}", 3, 1) for i in range(203)] + [(None, None, 3, 1), (5, "", 3, 1)] + [(8, "same", 3, 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, _n int")
    out = sharding.shard_documents(docs, 8).collect()
    check(out, len(rows), 8)
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _, _ in rows)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out)
    again = sharding.shard_documents(docs.repartition(3), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    check(sharding.shard_documents(docs.limit(3), 8).collect(), 3, 8)
    assert sharding.shard_documents(docs.where("false"), 8).count() == 0


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 8)
    docs = spark.range(32).selectExpr("id as doc_id", "'x' as text")
    where, slots = Counter(), Counter()
    for seed in range(20):
        for r in sharding.shard_documents(docs, 4, seed).collect():
            where[r.doc_id < 16, r.shard] += 1
            slots[r.doc_id < 16, r.slot < 4] += 1
    assert all(50 < n < 110 for n in where.values()) and all(115 < n < 205 for n in slots.values())


def test_query(spark):
    from pageloom.llm.queries import QUERIES
    check(QUERIES["op7_sharding"](spark, SMALL).collect(), 200, 8)
