import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pageloom.llm import simhash


def by_hand(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps):
    """Smallest id reachable, by comparing all."""
    parent = {i: i for i in fps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(fps, 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: top(i) for i in fps}


def test_golay_code_is_perfect_and_keys_meet():
    words = np.arange(1 << 23, dtype=np.int64)
    assert np.bincount(simhash.golay_index(words), minlength=4096).tolist() == [2048] * 4096
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        two = np.array([a, b], np.uint64).view(np.int64)
        rows, keys, sides = simhash.keys_of(two)
        filed = {(r, k) for r, k, s in zip(rows, keys, sides) if s != 1}
        asked = {(r, k) for r, k, s in zip(rows, keys, sides) if s != 0}
        assert {k for r, k in filed if r == 0} & {k for r, k in asked if r == 1}


def test_fingerprints_match_plain_code_and_sparks_hash(spark):
    texts = ["", None, " \t", "A b", "one Two three four", "É é ſ K x y z", "a a a a a a", "x" * 5000 + " y z"]
    assert [simhash.fingerprint_of(t) for t in texts] == [by_hand(t) for t in texts]
    row = spark.sql("select xxhash64('one two three') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_components_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for group in range(12):
        base = rng.choices(vocabulary, k=400)
        for copy in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts) * 3 + 1] = " ".join(words)
    texts[1000], texts[1001], texts[1002] = None, "", " \n"
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in texts.items()], "doc_id long, text string, fp int, root string")
    want = grouped({i: by_hand(t) for i, t in texts.items()})
    assert len(set(want.values())) < len(want)
    for dense in (1024, 1):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, dense=dense).collect()}
        assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeats_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "other words here now"), (2, "different")],
                                 "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=str)
    assert simhash.keep_one(docs).count() == 3
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_grown_tables_are_not_broadcast(spark, tmp_path):
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    edges = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    inner = [line.split("Join")[0].split()[-1] for line in plan.splitlines() if "Join" in line and ", Inner" in line]
    assert inner == ["SortMerge", "SortMerge"]
