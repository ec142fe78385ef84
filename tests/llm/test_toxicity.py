import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pageloom.llm import toxicity


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(2, 2))
    sizes = np.array([5, 3, 3, 1])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = rng.normal(size=sizes.sum()) * 2
    p, pairs, log_z = toxicity.marginals(scores, first, sizes, moves)
    want, moved, logs = np.zeros(len(scores)), np.zeros((2, 2)), 0.0
    for a, n in zip(first, sizes):
        total, seen, jumps = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[a + i] * k for i, k in enumerate(tags)) + sum(moves[x, y] for x, y in zip(tags, tags[1:])))
            total += w
            seen += w * np.array(tags)
            for x, y in zip(tags, tags[1:]):
                jumps[x, y] += w
        want[a:a + n], logs = seen / total, logs + np.log(total)
        moved += jumps / total
    assert np.allclose(p, want) and np.allclose(pairs, moved) and np.isclose(log_z, logs)


def test_covering_ignores_words_of_copies():
    docs = [{"vile", "rider"}] * 5 + [{"vile", "x"}, {"foul"}, {"foul", "y"}, {"foul"}] + [{"vile", "base"}] * 9
    counts = {"vile": (15, 0), "rider": (5, 0), "foul": (3, 0), "x": (9, 50), "base": (9, 0)}
    assert toxicity.cover(docs, counts, 0.9, 3) == {"vile", "foul", "base"}


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Rotten", "vile", "scumbag"]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_learned_scores_and_offsets(spark):
    rows = corpus(600, 9)
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t, _ in rows], "doc_id long, text string, spans string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(3, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.learn(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = toxicity.score(docs, chain).collect()
    held = [r for r in got if r.doc_id >= 400]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.98
    for r in held:
        assert {r.text[s.start:s.end] for s in r.spans} <= {"Rotten", "vile", "scumbag"}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " ... \n"), (4, "vile " * 20000), (4, "vile " * 20000)], "doc_id long, text string")
    values = [(r.doc_id, round(r.score, 3), len(r.spans)) for r in toxicity.score(odd, chain).collect()]
    assert values[:3] == [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)] and values[3] == values[4] == (4, 1.0, 20000)
    assert toxicity.score(odd.where(F.lit(False)), chain).count() == 0
    blind = toxicity.learn(docs, labels.where(F.lit(False)))
    assert not blind.weights and toxicity.score(docs, blind, spans=False).where("score > 0.5").count() == 0


def test_support_comes_from_evidence():
    assert toxicity.least_support(880, 7120, 30) == 7 and toxicity.least_support(500, 500, 30) == 22
    assert toxicity.least_support(0, 9, 30) is None and toxicity.least_support(9, 0, 30) is None
    assert toxicity.ratio(7, 0, 880, 7120) > 30 > toxicity.ratio(6, 0, 880, 7120) and abs(toxicity.ratio(11, 89, 11, 89)) < 1e-9


def test_long_tailed_words_are_found(spark):
    rng = random.Random(12)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    vile = ["".join(rng.choice("bcdfgklmnprstz") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(6000):
        words = rng.choices(plain, k=rng.randint(5, 30))
        if i % 5 == 0:  # each of the 60 words in about 2 % of the toxic documents
            words.insert(rng.randrange(len(words)), rng.choice(vile))
        rows.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:5000]], "doc_id long, toxic int")
    got = toxicity.score(docs.where("doc_id >= 5000"), toxicity.learn(docs, labels)).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in got]) > 0.97
