import hashlib
import random
import zlib

import pytest

from pageloom.llm import prefixes
from tests.conftest import SMALL

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, level string"


def by_hand(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [m[2:] for m in sorted(ms)] for c, ms in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(c - (abs(c) % 5) * (1 if c > 0 else -1))
        rebuilt[c] = talks.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(ms) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, ms in members.items())


def got(spark, rows, **how):
    talk = spark.createDataFrame([(*r, 4, "x") for r in rows], SCHEMA)
    frame = prefixes.conversation_trie(talk, **how)
    assert frame.columns == FIELDS
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[:2], r[2] or 0, r[3:]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[:2], r[2] or 0, r[3:]))


EDGES = [(1, 2, "user", "hi"), (1, None, None, None), (1, 2, "user", "hi"), (1, 2, "a", "tie"), (2, 0, "user", ""), (3, 1, None, "x"),
         (None, 1, "user", "lost"), (7, 5, "user", "été" * 3000), (-3, 1, "user", "hi"), (-5, 1, "user", "hi"), (5, 1, "user", "hi"),
         (5, 2, "bot", "yo"), (6, 1, "q", "own")]


def drawn(seed, n=120, most=7):
    """Few texts, so that beginnings are shared; copies of one conversation make a hot path."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        same = draw.random() < 0.3
        for t in range(6 if same else draw.randint(1, most)):
            rows.append((c, t, "ab"[t % 2], f"hot {t}" if same else "é" * draw.randint(0, 2)))
    return rows


def long_copies():
    """Conversations that share much more than a segment, some of them to the end."""
    rows = [(c, t, "u", f"t{t}") for c in (100, 101, 102, 105, 110) for t in range(45 - 7 * (c == 110))]
    return rows + [(c, t, "u", f"t{t}" if t < 20 + c % 7 else f"{c} {t}") for c in (115, 120, 125, 131) for t in range(41)]


@pytest.mark.parametrize("rows,width", [(EDGES, 32), (EDGES, 1), (drawn(1), 32), (drawn(2), 2), (long_copies() + drawn(3, 40), 4),
                                        (long_copies() + EDGES, 32)])
def test_against_plain_code(spark, rows, width):
    assert got(spark, rows, width=width) == ordered(by_hand(rows))


def test_hot_path_over_many_shards(spark, monkeypatch):
    """One task a few rows: every node of the hot path is partial, its ends come in chunks."""
    rows = drawn(5, 400)
    chunk = prefixes.CHUNK
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert got(spark, rows) == ordered(by_hand(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert chunk == 1 << 16


def test_crowded_turns_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CROWDED", 5)
    rows = [(10, None, "r", f"{i % 9}") for i in range(40)] + [(10, 3, "ab"[i % 2], "same") for i in range(30)] + drawn(6, 30)
    rows += [(11, i, "r", "x") for i in range(300)]
    assert got(spark, rows) == ordered(by_hand(rows))
    assert prefixes.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixes.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "c")], SCHEMA)).count() == 0


def test_twin(spark, duck):
    from pageloom.llm.queries import QUERIES
    rows = sorted(map(tuple, QUERIES["op12_trie"](spark, SMALL).select(FIELDS).collect()), key=repr)
    assert rows == sorted(duck.execute(f"select {', '.join(FIELDS)} from ({prefixes.ORACLE})").fetchall(), key=repr)
