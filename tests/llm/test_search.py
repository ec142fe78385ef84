import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import search
from tests.conftest import SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in own if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, rank + 1, i if given else None, -s) for rank, (s, given, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "... !"), (4, "Alpha beta GAMMA"), (5, "alpha alpha alpha"), (6, "beta-gamma, été"), (6, "beta-gamma, été"),
        (None, "alpha beta gamma"), (7, "delta " * 20000 + "alpha"), (9, "ÉTÉ 42 été x1"), (8, "alpha beta gamma"), (-3, "alpha beta gamma")]
DOCS += [(100 + i, f"common w{i % 7} w{i % 11} w{i % 3}") for i in range(200)]
ITEMS = [(1, "alpha beta"), (2, None), (3, "nowhere"), (4, "ÉTÉ 42"), (None, "gamma"), (1, "gamma alpha alpha"), (5, "common w1 w2 w3 w4"), (6, "!!")]


@pytest.mark.parametrize("k,slices", [(3, 1 << 25), (50, 60), (1, 1 << 25)])
def test_against_plain_code(spark, k, slices):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, rank int, score int").repartition(5)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = search.search(docs, items, k, max_slice_bytes=slices)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(DOCS, ITEMS, k)
    assert search.search(docs.where("false"), items, k).count() == 0
    assert search.search(docs, items.where("false"), k).count() == 0


def test_positions_stop_early_and_exactly():
    """Random lists: the k best are found, ties at the kth score included, and not everything is read."""
    draw, saved = np.random.default_rng(3), 0
    for trial in range(60):
        n, m = 3000, int(draw.integers(1, 6))
        base = draw.pareto(1.0, n)
        term, doc, impact = [], [], []
        for t in range(m):
            held = np.flatnonzero(draw.random(n) < draw.random())
            term.append(np.full(len(held), t)), doc.append(held)
            impact.append((base[held] * 10 + draw.integers(0, 4, len(held))).astype(np.int64) if trial % 2
                          else draw.integers(0, 3, len(held)))
        term, doc, impact = map(np.concatenate, (term, doc, impact))
        found = search.Search(search.Lists(term, doc, impact), np.arange(m + 2), n)
        docs, scores = found.top(10, 1)
        whole = np.bincount(doc, impact, n).astype(np.int64)
        want = sorted((-s, d) for d, s in enumerate(whole.tolist()) if s > 0)[:10]
        assert sorted((-s, d) for d, s in zip(docs.tolist(), scores.tolist()))[:10] == want
        saved += found.read < np.count_nonzero(whole) / 2
    assert saved > 20


def test_best_positions_bound_more_tightly():
    """One list's head is seen through the other: its best position lies beyond what was read."""
    term = np.repeat([0, 1], 400)
    doc = np.concatenate([np.arange(400), np.arange(400)])
    impact = np.concatenate([1000 - np.arange(400), 1000 - np.arange(400)])
    found = search.Search(search.Lists(term, doc, impact), np.arange(2), 400)
    found.scores(np.arange(100))
    assert found.bound() == 2 * 900 and found.best == [100, 100]


def test_blocks_keep_every_row(monkeypatch):
    import pyarrow as pa
    sizes = [random.Random(i).randint(0, 12) for i in range(500)] + [90, 0, 0, 95]
    batches = [pa.record_batch({"id": pa.array(range(a, b)), "terms": pa.array([[1] * n for n in sizes[a:b]], pa.list_(pa.int32()))})
               for a, b in ((0, 3), (3, 3), (3, 300), (300, 504))]
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(search, "BLOCK_ROWS", 9)
    blocks = list(search._blocks(iter(batches)))
    assert [i for b in blocks for i in b["id"].to_pylist()] == list(range(504))
    assert all(len(b) <= 9 and (len(b["terms"].combine_chunks().flatten()) <= 40 or len(b) == 1) for b in blocks)


def test_twin(spark, duck):
    from pageloom.llm.queries import QUERIES
    got = sorted(map(tuple, QUERIES["op13_search"](spark, SMALL).collect()))
    assert got == sorted(duck.execute(search.ORACLE).fetchall()) and got
