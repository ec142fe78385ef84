import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pageloom.llm import quality
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    hit = {j for i, w in enumerate(wins) if often[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)


TEXTS = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "x x x x x", "é\xa0ü z y #*", "one\none\n\none\n two", "a|b <c> $5 & 100%",
         "w " * 30000, " ".join(f"w{i}" for i in range(60)), "\x0bstart " + " ".join(f"v{i % 40}" for i in range(90))]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(TEXTS)] + [(3, "a b", 1, "q")],
                                 "doc_id long, text string, n_words int, _words string")
    got = quality.judge(docs, docs.select("doc_id").where("doc_id > 10")).collect()
    assert len(got) == len(docs.collect())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(TEXTS[r.doc_id]), r
    assert quality.judge(docs.where(F.lit(False)), docs).count() == 0
    assert quality.judge(docs, docs.where(F.lit(False))).where("kept").count() == sum(not base(t)[5] for t in TEXTS)


def test_scores_and_threshold_against_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    good = {r.doc_id for r in trusted.collect()}
    n = 257
    hashed = {}

    def bucket(*w):
        return hashed[w]

    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    grams = {i: [(w,) for w in ws] + list(zip(ws, ws[1:])) for i, ws in texts.items()}
    one = sorted({g[0] for gs in grams.values() for g in gs if len(g) == 1})
    two = sorted({g for gs in grams.values() for g in gs if len(g) == 2})
    for r in spark.createDataFrame([(w,) for w in one], "a string").select("a", F.pmod(F.xxhash64("a"), F.lit(n)).alias("h")).collect():
        hashed[r.a,] = r.h
    for r in spark.createDataFrame(two, "a string, b string").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(n)).alias("h")).collect():
        hashed[r.a, r.b] = r.h
    every, top = Counter(), Counter()
    for i, gs in grams.items():
        every.update(bucket(*g) for g in gs)
        if i in good:
            top.update(bucket(*g) for g in gs)
    e, t = sum(every.values()) + n, sum(top.values()) + n
    ratio = [math.log((top[b] + 1) / t) - math.log((every[b] + 1) / e) for b in range(n)]
    want = {i: sum(ratio[bucket(*g)] for g in gs) / len(gs) if gs else 0.0 for i, gs in grams.items()}
    got = quality.judge(docs, trusted, buckets=n, lost_share=0.05).collect()
    assert all(abs(want[r.doc_id] - r.llr) < 1e-9 for r in got)
    passing = sorted(r.llr for r in got if r.doc_id in good and not r.base_failed)
    lost = [r for r in got if r.doc_id in good and not r.base_failed and not r.kept]
    assert len(lost) <= 0.05 * len(passing)
    kept = [r.llr for r in got if r.kept]
    assert min(kept) > max([r.llr for r in got if not r.kept and not r.base_failed], default=-9)
