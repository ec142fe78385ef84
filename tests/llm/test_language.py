import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pageloom.llm import language
from tests.conftest import SMALL


def model_of(langs, words, penalty):
    keys = np.unique(language.gram_hashes(words, 3)[0])
    rng = np.random.default_rng(3)
    writes = np.ones((len(language.SCRIPTS) + 1, len(langs)), bool)
    return language.Model(langs, keys, rng.normal(size=(len(keys), len(langs))).astype(np.float32), writes, 3, penalty)


def test_grams_are_those_of_the_words():
    words = ["ab", "zebra", "é", "x" * 100]
    hashes, owners, firsts = language.gram_hashes(words, 4)
    of = {}
    for w, i in zip(words, range(len(words))):
        marked = f"<{w}>"
        grams = [marked[k:k + n] for n in (1, 2, 3, 4) for k in range(len(marked) - n + 1)]
        mine = hashes[owners == i].tolist()
        assert len(mine) == len(grams)
        for g, h in zip(grams, mine):
            assert of.setdefault(g, h) == h
    assert len(set(of.values())) == len(of) and [chr(c) for c in firsts] == ["a", "z", "é", "x"]


def test_long_and_mixed_runs_are_cut_and_scored_whole(spark):
    cut = lambda t: language.pieces(t).findall(t)
    assert [len(w) for w in cut("a" * 200)] == [64, 64, 64, 8]
    assert cut("houseдом7riverрека") == ["house", "дом", "river", "река"]
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [(i, " ".join(draw(letters, 6) for _ in range(40)), lang) for i in range(60)
            for letters, lang in (("abcdefg", "aa"), ("nopqrst", "bb"), ("абвгде", "cc"))]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    run = draw("abcdefg", 64) + draw("nopqrst", 128)
    assert model.label([run + draw("абвгде", 8)], True).to_dict("records") == [{"lang_pred": "bb", "score": 0.64, "spans": [
        {"start": 0, "end": 64, "lang": "aa"}, {"start": 64, "end": 192, "lang": "bb"}, {"start": 192, "end": 200, "lang": "cc"}]}]


def test_viterbi_against_all_paths():
    rng = random.Random(2)
    words = [f"word{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(8)]
    for penalty in (0.0, 0.7, 3.0):
        model = model_of(["a", "b", "c"], words, penalty)
        texts = [rng.choices(words, k=rng.randint(0, 6)) for _ in range(25)]
        sizes = np.array([len(t) for t in texts])
        paths = np.split(model.paths([w for t in texts for w in t], sizes), np.cumsum(sizes)[:-1])
        for text, path in zip(texts, paths):
            def total(p):
                return sum(model.table([w])[0][k] for w, k in zip(text, p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            best = max((total(p) for p in itertools.product(range(3), repeat=len(text))), default=0)
            assert len(path) == len(text) and abs(total(path.tolist()) - best) < 1e-4


def test_scripts_narrow_and_spans_cover_mixed_text(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choices("the and of with house river stone".split(), k=30)), "en"))
        rows.append((1000 + i, " ".join(rng.choices("der und von mit haus fluss stein".split(), k=30)), "de"))
        rows.append((2000 + i, " ".join(rng.choices("и в на дом река камень".split(), k=30)), "ru"))
    docs = spark.createDataFrame(rows + [(9, None, "en"), (10, "text", None)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.langs == ["de", "en", "ru"]
    assert model.table(["зима", "house"]).argmax(axis=1).tolist() == [2, 1]
    mixed = "the house and the river " * 4 + "und der fluss von mit haus " * 3 + "дом и река"
    asked = spark.createDataFrame([(1, mixed, "x", 1.5), (2, None, "x", 0.0), (3, " 12 !?", "x", 0.0), (4, "", "x", 0.0),
                                   (5, "der fluss " * 20000, "x", 0.0), (5, "der fluss " * 20000, "x", 0.0)],
                                  "doc_id long, text string, spans string, score double")
    got = {r.doc_id: r for r in language.identify(asked, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"]
    assert mixed[got[1].spans[2].start:got[1].spans[2].end] == "дом и река"
    assert [(got[i].lang_pred, got[i].score, list(got[i].spans)) for i in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert (got[5].lang_pred, got[5].score) == ("de", 1.0)
    assert language.identify(asked.where(F.lit(False)), model).count() == 0
    nothing = language.learn(docs.where(F.lit(False)))
    assert {r.lang_pred for r in language.identify(asked, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from pageloom.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language"](spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
