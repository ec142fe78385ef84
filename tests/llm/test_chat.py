from pageloom.llm import chat
from tests.conftest import SMALL

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|im_end|> é"), (1, 3, "ann", None), (1, 3, "cid", ""),
        (2, None, None, "who am I"), (2, 5, "ann", "x" * 50000), (2, 5, "ann", "x" * 50000), (None, 1, "ann", "lost"),
        (None, 2, "bob", "found"), (3, 1, "system", "alone")] + [(4, i, "ab"[i % 2], f"m{i}") for i in range(600)]


def by_hand(rows, block):
    talks = {}
    for c, t, r, x in rows:
        r = "unknown" if r is None else r.replace("<|", "< |")
        talks.setdefault(c, []).append((t is not None, t or 0, r, (x or "").replace("<|", "< |")))
    out = {}
    for c, ms in talks.items():
        for who in {m[2] for m in ms if m[2] != "system"}:
            for timed, t, r, x in sorted(ms):
                text, mask, n = out.get((c, who, t // block if timed else -1), ("", [], 0))
                text += "<|im_start|>" + ("assistant" if r == who else r if r == "system" else f"user name={r}") + "\n"
                if r == who:
                    mask = mask + [(len(text), len(text) + len(x) + 10)]
                out[c, who, t // block if timed else -1] = (text + x + "<|im_end|>\n", mask, n + 1)
    return out


def test_against_plain_code(spark):
    talk = spark.createDataFrame([r + (7, "q") for r in ROWS],
                                 "conv_id long, turn long, role string, text string, part int, perspective string")
    for block in (256, 2):
        got = {(r.conv_id, r.perspective, r.part): (r.text, [tuple(m) for m in r["mask"]], r.n_turns)
               for r in chat.rotate(talk, block).collect()}
        assert got == by_hand(ROWS, block)
        for text, mask, _ in got.values():
            assert all(text[b - 10:b] == "<|im_end|>" for a, b in mask)
    assert chat.rotate(talk.where("false")).count() == 0


def test_twin(spark, duck):
    from pageloom.llm.queries import QUERIES
    frame = QUERIES["op1_chat"](spark, SMALL)
    names = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(*names).collect()))
    assert got == sorted(duck.execute(f"select {', '.join(names)} from ({chat.ORACLE})").fetchall())


def test_crowded_turns_are_cut(spark):
    """Null conversations, tied and null turns: parts stay bounded and join to the whole dialogue."""
    rows = [(None, i % 3, "ab"[i % 2], f"m{i // 2 % 40}") for i in range(500)] + [(None, 700, "a", "late"), (None, None, "b", "early")]
    rows += [(5, None, "ann", "same")] * 90 + [(5, 3, "bob", f"x{i}") for i in range(45)] + [(5, 300, "ann", "end"), (6, 0, "ann", "calm"), (6, 600, "bob", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {}
    for (c, who, part), (text, mask, n) in sorted(by_hand(rows, 256).items(), key=lambda x: (str(x[0][0]), x[0][1], x[0][2])):
        old, marks, count = whole.get((c, who), ("", [], 0))
        whole[c, who] = (old + text, marks + [(a + len(old), b + len(old)) for a, b in mask], count + n)
    got, sizes = {}, []
    for r in sorted(chat.rotate(talk, most=16).collect(), key=lambda r: r.part):
        old, marks, count = got.get((r.conv_id, r.perspective), ("", [], 0))
        got[r.conv_id, r.perspective] = (old + r.text, marks + [(m.start + len(old), m.end + len(old)) for m in r["mask"]], count + r.n_turns)
        sizes.append((r.conv_id, r.perspective, r.part))
        assert r.n_turns <= 16
    assert got == whole and len(set(sizes)) == len(sizes)
    assert [p for c, w, p in sizes if (c, w) == (6, "ann")] == [0, 2]
