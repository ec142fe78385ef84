import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pageloom.llm import packing
from tests.conftest import SMALL

PATH = P.path("byte_bpe_50k.json")


class PlainBins:
    """The same rule with a list of bins instead of a bitset."""

    def __init__(self, capacity, limit):
        self.capacity, self.limit, self.bins, self.made = capacity, limit, [], 0

    def place(self, need):
        best = min((b for b in self.bins if b[1] >= need), key=lambda b: b[1], default=None)
        if best is None:
            if len(self.bins) == self.limit:
                self.bins.remove(min(self.bins, key=lambda b: b[1]))
            best = [self.made, self.capacity]
            self.made += 1
        else:
            self.bins.remove(best)
        offset = self.capacity - best[1]
        best[1] -= need
        if best[1]:
            self.bins.append(best)
        return best[0], offset


@pytest.mark.parametrize("capacity,limit", [(10, 1), (10, 3), (64, 16), (1024, 40)])
def test_bins_against_plain_code(capacity, limit):
    draw = random.Random(capacity + limit)
    fast, plain = packing.OpenBins(capacity, limit), PlainBins(capacity, limit)
    for _ in range(3000):
        need = draw.randint(1, capacity)
        assert fast.place(need) == plain.place(need)
        assert fast.open == len(plain.bins) <= limit
    with pytest.raises(ValueError):
        fast.place(capacity + 1)


def whole(rows, want, capacity):
    """Every document's pieces meet, sequences are gapless, ids are the library's."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in want.items():
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert got[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(got, got[1:]))
        assert got[-1].start + got[-1].length == len(ids) and all(r.length == capacity for r in got[1:])
        assert len(ids) > capacity or len(got) == 1
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence


def test_edges(spark):
    texts = {1: None, 2: "", 3: "hello  world's \n\n end ", 4: "word " * 700, 5: "x<|endoftext|> y", 6: "été 日本語 \U0001f600" * 90, 7: "a" * 9000}
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in texts.items()], "doc_id long, text string, length int, ids string")
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    packed = packing.pack_documents(docs, PATH, P.PATTERN, 2, capacity=100, ids=True).collect()
    whole(packed, want, 100)
    assert {r.doc_id: r.length for r in packed if r.doc_id < 3} == {1: 1, 2: 1}
    for r in packed:
        assert list(r.ids) == want[r.doc_id][r.start:r.start + r.length]
    joined = {r.sequence_id: list(r.ids) for r in packing.sequences(spark.createDataFrame(packed)).collect()}
    for r in packed:
        assert joined[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids)
    assert packing.pack_documents(docs.where("false"), PATH, P.PATTERN, 2).count() == 0


def test_long_text_in_runs(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        coder = packing.Coder(file.read(), P.PATTERN)
    text = "one two,\n three  \t four's " * 300
    at_once = coder.ids(text)
    monkeypatch.setattr(packing, "BATCH_CHARS", 50)
    monkeypatch.setattr(packing, "RUN", 7)
    monkeypatch.setattr(packing, "MEMO", 2)
    assert coder.ids(text) == at_once == np.array(Tokenizer.from_file(PATH).encode(text).ids, "<u4").tobytes()


def test_merging_and_parting_as_the_libraries_do():
    """Merges by id, the library's own, and both patterns give one result on texts of all scripts."""
    with open(PATH, encoding="utf-8") as file:
        definition = file.read()
    quick, library = packing.quick_pattern(P.PATTERN), Tokenizer.from_str(definition)
    known = json.loads(definition)
    assert packing.merges_by_id(known | {"model": known["model"] | {"merges": known["model"]["merges"][::-1]}}) is None
    draw = random.Random(9)
    ranges = [(32, 127), (160, 600), (0x300, 0x700), (0x900, 0xE00), (0x2000, 0x2200), (0x2150, 0x2190), (0x3000, 0x9FFF), (0x1F300, 0x1F700)]
    texts = ["".join(chr(draw.randint(*draw.choice(ranges[:1 + i % 8])) if draw.random() < 0.9 else draw.choice([32, 10, 9, 0x1C, 0x85]))
                     for _ in range(200)) for i in range(200)] + ["it's we'll ''s 'S _a_ 1_2 \u00b2\u00bd\u2167 a\u0301b", "x<|endoftext|>y  "]
    coders = [packing.Coder(definition, P.PATTERN), packing.Coder(definition, P.PATTERN, quick)]
    for t in texts:
        want = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert [c.ids(t) for c in coders] == [want, want]
    assert any(coders[1].quick[1].search(t) for t in texts) and not all(coders[1].quick[1].search(t) for t in texts)


def test_repeated_rows_and_a_hot_null_id(spark):
    docs = spark.createDataFrame([(None, "the same text again")] * 300 + [(i, "word " * (i % 90)) for i in range(600)], "doc_id long, text string")
    packed = packing.pack_documents(docs, PATH, P.PATTERN, 2, capacity=128, per_task=200)
    rows = packed.collect()
    assert len(rows) == 900 and len({(r.sequence_id, r.offset) for r in rows}) == 900
    assert len({r.sequence_id >> 40 for r in rows if r.sequence_id >= 0}) == 5
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack_documents(docs, PATH, P.PATTERN, 2, capacity=128, per_task=200).collect()))


def test_query(spark):
    from pageloom.llm.queries import QUERIES
    rows = QUERIES["op11_packing"](spark, SMALL).collect()
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {d.doc_id: library.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs}
    sequences = whole(rows, want, 1024)
    assert len(sequences) <= 1.02 * sum(map(len, want.values())) / 1024 + 1
