import re

import pytest

from pageloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(size, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


P = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, P), (2, "Tiny Item"), (10, P.upper() + "!"), (3, None), (4, "..."), (5, "été-là über ñ"), (None, "solo"), (1, P),
         (6, "alpha " * 15)]
DOCS = [(1, f"x {P} y tiny item"), (2, "Tiny, ITEM tiny item"), (3, None), (4, ""), (5, "ÉTÉ là über ñ été là über ñ"), (5, "solo"),
        (6, "alpha " * 30000), (None, P), (7, " ".join(P.split()[:9])), (8, "clean text without anything of it"), (9, f"{P} {P} tiny")]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_against_plain_code(spark, bound):
    docs = spark.createDataFrame([(i, t, 3, "q") for i, t in DOCS], "doc_id long, text string, n_hit int, words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.scan(docs, items, max_broadcast_windows=bound).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == by_hand(DOCS, ITEMS)
    assert decontam.scan(docs.where("false"), items, max_broadcast_windows=bound).count() == 0
    none = decontam.scan(docs, items.where("false"), max_broadcast_windows=bound)
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(DOCS)


def test_removal(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in DOCS], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 7, 8]
    cut = {(r.doc_id, r.text) for r in decontam.decontaminate(docs, items, remove="spans").collect()}
    assert {(1, "x  y "), (2, ", "[2:]), (3, None), (8, "clean text without anything of it")} <= cut
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, items, remove="all")


def test_twin(spark, duck):
    from pageloom.llm.queries import QUERIES
    got = sorted(map(tuple, QUERIES["op4_decontaminate"](spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duck.execute(decontam.ORACLE).fetchall())
    assert any(r[5] for r in got)
