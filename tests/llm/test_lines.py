import hashlib

import duckdb

from pageloom.llm import lines
from tests.compare import connect

BLANK = " \t\n\x0b\x0c\r"


def by_hand(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    cut = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, ls in cut:
        for line in ls:
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, ls in cut:
        kept = []
        for line in ls:
            ids = holders.get(key(line), set())
            top = max((x for x in ids if x is not None), default=None)
            if len(ids) < 5 or i == top:
                kept.append(line)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG = "This line of exactly repeated words is long enough É"
ROWS = ([(i, f"{LONG}\nown {i}\n \t{LONG.replace('T', 't')}\x0b\nshort") for i in range(9)]
        + [(20, None), (21, ""), (22, "\n\n"), (23, "x" * 200000 + "\n" + LONG.lower()), (24, LONG.replace("É", "é")),
           (5, LONG + "\nanother text of a repeated id"), (5, LONG + "\nanother text of a repeated id"),
           (None, LONG + "\ntail"), (None, "a" * 40 + "\n" + LONG), (30, ("b" * 40 + "\n") * 3 + "c" * 39)]
        + [(40 + i, "b" * 40 + "\n" + "c" * 39 + "\n" + "d" * 40) for i in range(4)])


def test_against_plain_code(spark):
    docs = spark.createDataFrame([(i, t, 1, True, "k") for i, t in ROWS],
                                 "doc_id long, text string, n_lines int, kept boolean, line string")
    got = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(((r[0], r[1], r[2], r[3] or "") for r in got), key=str) == by_hand(ROWS)
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_keep_bitmaps_are_run_lengths(spark):
    docs = spark.createDataFrame(ROWS[:9], "doc_id long, text string")
    runs = {r.doc_id: [tuple(x) for x in r.kept] for r in lines.keep_bitmaps(docs).collect()}
    assert runs[8] == [(0, 4)] and all(runs[i] == [(1, 1), (3, 1)] for i in range(8))


def test_twin(spark, duck):
    from pageloom.llm.queries import QUERIES
    got = sorted(map(tuple, QUERIES["op2_line_dedup"](spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duck.execute(lines.ORACLE).fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r[3] for r in got} or got
