"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so token labels are inferred first: sequential
covering picks the words that explain most of the toxic documents and hardly
occur in others, until none explains enough of the rest to be told from chance (words that merely ride
along in copies of one toxic document explain nothing new); beginnings of words
count as well, for inflected words.  A two-state
chain is then fitted on sentences with these tokens tagged.  Forward-backward
marginals of every sentence give toxic spans; a document's score is the
probability that at least one of its spans is toxic, or the largest marginal
if it has none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.core.shared import written
from pageloom.llm.batches import bounded

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")
#: Tokens at least this likely to be toxic are spans; less likely ones do not add up, however long the text.
SPAN_AT = 0.5
#: Characters of text that a task works on at a time.
BATCH_CHARS = 2_000_000
RESULT = "score double"
SPANS = RESULT + ", spans array<struct<start:int,end:int,p:double>>"


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words by sentence."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall((text or "").lower()):
        if token in _STOPS:
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def units(word: str) -> set[str]:
    """What may mark a word as toxic: the word itself or its beginning, as in inflected words."""
    return {word} | {word[:n] + "*" for n in (4, 5, 6) if len(word) > n}


def features(word: str) -> list[str]:
    """What a word says about its own label."""
    ends = [f"head={word[:n]}" for n in (3, 4, 5, 6)] + [f"tail={word[-n:]}" for n in (3, 4)]
    return [f"w={word}", *ends, f"size={min(len(word), 12)}", "all"]


@dataclass
class Chain:
    """Weights of the toxic state's features (the other state scores 0) and of transitions.

    A feature not seen in training weighs nothing.
    """

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def word(self, word: str) -> tuple[float, float, float]:
        """Score for itself, for its right neighbour and for its left neighbour."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word)), get(f"before={word}", 0.0), get(f"after={word}", 0.0)

    def scores(self, words: list[str], at: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Emission score of each token; ``at`` numbers tokens in ``words``, ``inner`` lists those not first in a sentence."""
        table = np.array([self.word(w) for w in words]).reshape(len(words), 3)
        out = table[at, 0]
        out[inner] += table[at[inner - 1], 1]
        out[inner - 1] += table[at[inner], 2]
        return out


def marginals(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) of each token, expected transitions, and the log partition sum.

    All sentences advance together; ``sizes`` fall.
    """
    n, longest = len(scores), int(sizes[0]) if len(sizes) else 0
    jump = np.exp(moves)
    ahead = np.zeros((n, 2))
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    log_z = 0.0
    weight = np.exp(np.stack([np.zeros(n), np.clip(scores, -40, 40)], axis=1))
    now = np.zeros((0, 2))
    for t in range(longest):
        at = first[:active[t]] + t
        now = weight[at] if t == 0 else (now[:active[t]] @ jump) * weight[at]
        norm = now.sum(axis=1, keepdims=True)
        log_z += float(np.log(norm).sum())
        now = now / norm
        ahead[at] = now
    behind = np.ones((n, 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[:active[t + 1]] + t
        nxt = weight[at + 1] * behind[at + 1]
        back = nxt @ jump.T
        joint = ahead[at][:, :, None] * jump[None] * nxt[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind[at] = back / back.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / np.maximum(both.sum(axis=1), 1e-300), pairs, log_z


def _laid(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """Sentences laid end to end, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    return [w for i in order for w in texts[i]], first, sizes, order


def fit_chain(texts: list[list[str]], toxic: frozenset[str], rounds: int = 80, rate: float = 0.4, l2: float = 2e-3,
              seen_often: int = 4) -> Chain:
    """Maximum likelihood by adaptive gradient steps over all sentences.

    Features of fewer than ``seen_often`` tokens are left out, so that the
    common ones learn what an unknown word is like.
    """
    texts = [t for t in texts if t]
    if not texts:
        return Chain()
    flat, first, sizes, _ = _laid(texts)
    gold = np.array([not toxic.isdisjoint(units(w)) for w in flat], float)
    inner = np.ones(len(flat), bool)
    inner[first] = False
    places = np.nonzero(inner)[0].tolist()
    tally = Counter(f for w, n in Counter(flat).items() for f in features(w) for _ in range(min(n, seen_often)))
    tally.update(f"before={flat[i - 1]}" for i in places)
    tally.update(f"after={flat[i]}" for i in places)
    index = {f: i for i, f in enumerate(sorted(f for f, n in tally.items() if n >= seen_often))}
    width = len(index) + 1  # the last place is for features left out
    emit, moves = np.zeros(width), np.zeros((2, 2))
    own = np.array([[index.get(f, width - 1) for f in features(w)] for w in flat])
    before = np.array([index.get(f"before={flat[i - 1]}", width - 1) for i in places], np.int64)
    after = np.array([index.get(f"after={flat[i]}", width - 1) for i in places], np.int64)
    place = np.array(places, np.int64)
    kinds = gold.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (kinds[place - 1], kinds[place]), 1)
    square, square_moves = np.full(width, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        score = emit[own].sum(axis=1)
        score[place] += emit[before]
        score[place - 1] += emit[after]
        p, pairs, _ = marginals(score, first, sizes, moves)
        gap = (gold - p) / len(texts)
        step = np.zeros(width)
        for column in range(own.shape[1]):
            step += np.bincount(own[:, column], gap, width)
        step += np.bincount(before, gap[place], width) + np.bincount(after, gap[place - 1], width)
        step -= l2 * emit / len(texts)
        moved = (seen - pairs) / len(texts) - l2 * moves / len(texts)
        square += step ** 2
        square_moves += moved ** 2
        emit += rate * step / np.sqrt(square)
        emit[-1] = 0.0
        moves += rate * moved / np.sqrt(square_moves)
    return Chain({f: float(emit[i]) for f, i in index.items()}, moves)


def least_support(bad: int, good: int, evidence: float) -> int | None:
    """Toxic documents that a unit without clean ones needs for a log-likelihood ratio of ``evidence``; None if no number does."""
    if not bad or not good:
        return None
    return max(3, math.ceil(evidence / (2 * math.log((bad + good) / bad))))


def ratio(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Log-likelihood ratio (G squared) of a unit's documents against the share of toxic ones among all."""
    def part(n: int, share: float) -> float:
        return 2 * n * math.log(n / ((bad + good) * share)) if n else 0.0

    share = all_bad / (all_bad + all_good)
    return part(bad, share) + part(good, 1 - share)


def cover(toxic_docs: list[set[str]], counts: dict[str, tuple[int, int]], purity: float, support: int) -> frozenset[str]:
    """Units that explain toxic documents, the most explaining first.

    Joined by their peers: units at least half as common in toxic documents as
    the most explaining one, which documents with several of them hide.
    """
    fair = {w for w, (bad, good) in counts.items() if bad >= support and bad >= purity * (bad + good)}
    left = [d & fair for d in toxic_docs]
    chosen = []
    while True:
        tally = Counter(w for d in left for w in d)
        if not tally:
            break
        word, n = min(tally.items(), key=lambda x: (-x[1], "*" in x[0], -len(x[0]), x[0]))
        if n < support:
            break
        chosen.append(word)
        left = [d for d in left if word not in d]
    peers = [w for w in fair if chosen and 2 * counts[w][0] >= counts[chosen[0]][0]]
    return frozenset(chosen) | frozenset(peers)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = 8000, sentences_of_each: int = 6000, purity: float = 0.9, evidence: float = 30.0,
          seed: int = 23) -> Chain:
    """Fit on about ``sample_rows`` labelled documents, drawn by a hash of the id.

    Null labels, ids and texts teach nothing; repeated labels of a document
    count once each way, and so do equal texts.  From the sample, about ``sentences_of_each``
    sentences with and without inferred toxic words are used.  Both are bounds
    of the fit only.  Without toxic examples every score is 0.

    A word counts by its log-likelihood ratio against all sampled documents, not
    by its share of the toxic ones: ``evidence`` 30 is a chance of 5 in 10^8,
    reached by 7 documents if 11 % are toxic.  A rarer word is not tagged; it
    scores by what it shares with tagged words and neighbours only.  Without
    clean documents nothing can be told from chance and every score is 0.
    """
    marked = (labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
              .groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y")))
    share = min(1.0, sample_rows / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = written(docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
                   .join(F.broadcast(drawn), "id").select("text", "y").distinct(), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                (bad if y else good).update({u for w in {w for s in sentences(t) for w in s} for u in units(w)})
        words = sorted(bad.keys() | good.keys())
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            yield pa.record_batch({"word": pa.array(part, pa.string()), "bad": pa.array([bad[w] for w in part], pa.int64()),
                                   "good": pa.array([good[w] for w in part], pa.int64())})

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    support = least_support(n_bad, n_good, evidence)
    if support is None:
        return Chain()
    counted = (rows.select("text", "y").mapInArrow(count, "word string, bad long, good long").groupBy("word")
               .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
               .where((F.col("bad") >= support) & (F.col("bad") >= purity * (F.col("bad") + F.col("good")))))
    counts = {r.word: (r.bad, r.good) for r in counted.collect() if ratio(r.bad, r.good, n_bad, n_good) >= evidence}
    if not counts:
        return Chain()
    fair = frozenset(counts)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted({u for s in sentences(t) for w in s for u in units(w)} & fair) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"words": pa.array(sets, pa.list_(pa.string()))})

    toxic_docs = [set(r.words) for r in rows.where("y = 1").select("text").mapInArrow(found, "words array<string>").collect()]
    toxic = cover(toxic_docs, counts, purity, support)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [s for t in batch["text"].to_pylist() for s in sentences(t)]
            hit = [any(not toxic.isdisjoint(units(w)) for w in s) for s in parts]
            yield pa.record_batch({"hit": pa.array(hit, pa.bool_()), "words": pa.array([s[:200] for s in parts], pa.list_(pa.string()))})

    parts = written(rows.select("text").mapInArrow(examples, "hit boolean, words array<string>"), "sentences")
    picked = []
    for hit, n in sorted((r.hit, r["count"]) for r in parts.groupBy("hit").count().collect()):
        chance = F.pmod(F.xxhash64(F.lit(seed), "words"), F.lit(1 << 30)) < int(min(1.0, sentences_of_each / n) * (1 << 30))
        picked += [list(r.words) for r in parts.where((F.col("hit") == hit) & chance).select("words").collect()]
    picked.sort()
    return fit_chain(picked, toxic)


def _judge(chain: Chain, texts: list[str | None], spans: bool) -> pd.DataFrame:
    flat: list[str] = []
    ends = []
    for text in texts:
        if text:
            flat += _TOKEN.findall(text.lower())
        flat.append("\n")
        ends.append(len(flat))
    known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    stop = np.isin(at, [known[x] for x in _STOPS if x in known])
    edge = np.concatenate([[True], stop])
    first = np.nonzero(edge[:-1] & ~stop)[0]
    sizes = np.searchsorted(np.nonzero(stop)[0], first, side="left")
    sizes = np.nonzero(stop)[0][sizes] - first
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    inner = np.nonzero(~stop & ~edge[:-1])[0]
    p = np.zeros(len(flat))
    if len(first) and chain.weights:
        p, _, _ = marginals(chain.scores(list(known), at, inner), first, sizes, chain.moves)
        p[stop] = 0.0
    del flat, at
    owner = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    most, log_clean = np.zeros(len(texts)), np.zeros(len(texts))
    np.maximum.at(most, owner, p)
    suspicious = np.nonzero(p >= SPAN_AT)[0]
    np.add.at(log_clean, owner[suspicious], np.log1p(-np.minimum(p[suspicious], 1 - 1e-12)))
    out = {"score": np.clip(np.maximum(1 - np.exp(log_clean), most), 0, 1)}
    if spans:
        listed: list[list[dict]] = [[] for _ in texts]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if ends else np.zeros(0, np.int64)
        spots, of = [], -1
        for k in suspicious.tolist():
            i = int(owner[k])
            if i != of:
                spots, of = [m.span() for m in _TOKEN.finditer(texts[i].lower())], i
            a, b = spots[k - int(begins[i])]
            listed[i].append({"start": a, "end": b, "p": float(p[k])})
        out["spans"] = listed
    return pd.DataFrame(out)


def score(docs: DataFrame, chain: Chain, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and, unless left out, the toxic words' offsets.

    Offsets are of the lower-cased text, which has the same length but for a
    few letters such as dotted capital I.  Null and empty texts score 0 and have
    no spans.  Columns of these names are replaced.
    """
    docs = docs.drop("score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(SPANS if spans else RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else None for t in texts]
        parts = [_judge(shared.value, values[a:b], spans) for a, b in bounded(values, BATCH_CHARS)]
        return pd.concat(parts, ignore_index=True)

    return docs.withColumn("_judged", judged(text)).select(*docs.columns, "_judged.*")
