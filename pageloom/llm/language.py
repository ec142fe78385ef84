"""Language identification by script, word scores and Viterbi.

The script of a word (by code-point ranges) leaves only the languages that
write in it.  Each remaining language scores the word by the log-odds of its
character n-grams.  Viterbi over a text's words, where changing the language
costs a penalty, labels spans of mixed text; the language with most letters is
the document's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core.shared import written
from pageloom.llm.batches import bounded

#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF)),
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),),
    "armenian": ((0x0530, 0x058F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "devanagari": ((0x0900, 0x097F),),
    "bengali": ((0x0980, 0x09FF),),
    "tamil": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
UNKNOWN = "und"
#: Characters of text that a task works on at a time.
BATCH_CHARS = 2_000_000
#: Letters that are scored together at most; a longer run is scored in pieces, so that spans can begin inside it.
PIECE = 64
RESULT = "lang_pred string, score double"
SPANS = RESULT + ", spans array<struct<start:int,end:int,lang:string>>"


_EDGES = sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_FROM = np.array([a for a, _, _ in _EDGES])
_TO = np.array([b for _, b, _ in _EDGES])
_SCRIPT = np.array([i for _, _, i in _EDGES])
_PRIME = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 20


def _ranges(*names: str) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for name in names for a, b in SCRIPTS[name])


_RARE = [name for name in SCRIPTS if name != "latin"]
_RARE_LETTER = re.compile(f"[{_ranges(*_RARE)}]")
_COMMON = rf"[^\W\d_{_ranges(*_RARE)}]{{1,{PIECE}}}"
_PLAIN = re.compile(_COMMON)
_MIXED = re.compile("|".join([_COMMON] + [rf"(?:(?=[{_ranges(name)}])[^\W\d_]){{1,{PIECE}}}" for name in _RARE]))


def pieces(text: str) -> re.Pattern:
    """The pattern of the words of ``text``: runs of letters, cut where the script changes and after ``PIECE`` letters.

    Latin letters and those of no listed script run together.
    """
    return _MIXED if _RARE_LETTER.search(text) else _PLAIN


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point; ``len(SCRIPTS)`` for any other."""
    at = np.searchsorted(_FROM, points, side="right") - 1
    return np.where((at >= 0) & (points <= _TO[at]), _SCRIPT[at], len(SCRIPTS))


def gram_hashes(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word) of the character n-grams (1 to ``longest``) of words with marked ends, and each word's first code point."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the word's end
    hashes, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        rolled = rolled[:len(points) - n + 1] * _PRIME + points[n - 1:]
        rolled ^= rolled >> np.uint64(31)
        whole = left[:len(rolled)] >= n
        hashes.append(rolled[whole])
        owners.append(owner[:len(rolled)][whole])
    return np.concatenate(hashes), np.concatenate(owners), points[np.cumsum(lengths) - lengths + 1]


@dataclass
class Model:
    """Log-odds of each n-gram by language, and the languages that write each script."""

    langs: list[str]
    keys: np.ndarray
    weights: np.ndarray
    writes: np.ndarray
    longest: int
    penalty: float
    slots: np.ndarray = field(init=False)

    def __post_init__(self):
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[(self.keys[::-1] % np.uint64(SLOTS)).astype(np.int64)] = np.arange(len(self.keys) - 1, -1, -1, dtype=np.int32)

    def table(self, words: list[str]) -> np.ndarray:
        """Score of lower-case words in every language; languages of other scripts lie far below."""
        hashes, owners, firsts = gram_hashes(words, self.longest)
        at = self.slots[(hashes % np.uint64(SLOTS)).astype(np.int64)]
        known = at >= 0
        known[known] = self.keys[at[known]] == hashes[known]
        at, owners = at[known], owners[known]
        counts = np.bincount(owners, minlength=len(words))
        scale = np.minimum(counts, 6) / np.maximum(counts, 1)
        score = np.stack([np.bincount(owners, self.weights[at, k], len(words)) * scale for k in range(len(self.langs))], axis=1)
        allowed = self.writes[scripts_of(firsts)]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), score, -50.0).astype(np.float32)

    def paths(self, flat: list[str], sizes: np.ndarray) -> np.ndarray:
        """Best language of every word of texts laid end to end; the texts advance together."""
        labels = np.zeros(len(flat), np.int64)
        if not flat:
            return labels
        known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        flat_at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        table = self.table(list(known))
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        switched = np.zeros((len(flat), len(self.langs)), bool)
        source = np.zeros(len(flat), np.int16)
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        best = table[flat_at[first[:active[0]]]].copy()
        final = np.zeros(len(order), np.int64)
        for t in range(1, longest + 1):
            n = active[t] if t < longest else 0
            if n < len(best):
                final[n:len(best)] = best[n:].argmax(axis=1)
                best = best[:n]
            if not n:
                break
            at = first[:n] + t
            top = best.argmax(axis=1)
            other = best[np.arange(n), top] - self.penalty
            change = other[:, None] > best
            switched[at], source[at] = change, top
            best = np.where(change, other[:, None], best) + table[flat_at[at]]
        now = np.zeros(len(order), np.int64)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            ending = sizes[:n] == t + 1
            now[:n][ending] = final[:n][ending]
            at = first[:n] + t
            labels[at] = now[:n]
            now[:n] = np.where(switched[at, now[:n]], source[at], now[:n])
        return labels

    def label(self, texts: list[str | None], spans: bool) -> pd.DataFrame:
        flat: list[str] = []
        lengths, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = pieces(text).findall(text) if text else []
            sizes[i] = len(words)
            lengths += map(len, words)
            if words:
                flat += " ".join(words).lower().split(" ")
        path = self.paths(flat, sizes)
        del flat
        n_langs = len(self.langs)
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(owner * n_langs + path, np.array(lengths, np.float64), len(texts) * n_langs).reshape(len(texts), n_langs)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        names = np.array(self.langs, dtype=object)[top]
        out = {"lang_pred": np.where(total > 0, names, UNKNOWN), "score": letters.max(axis=1) / np.maximum(total, 1)}
        if spans:
            begin = np.cumsum(sizes) - sizes
            out["spans"] = [self._spans(t, path[a:a + n]) for t, a, n in zip(texts, begin, sizes)]
        return pd.DataFrame(out)

    def _spans(self, text: str | None, path: np.ndarray) -> list[dict]:
        out: list[dict] = []
        for m, lang in zip(pieces(text or "").finditer(text or ""), path.tolist()):
            if out and out[-1]["lang"] == self.langs[lang]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": self.langs[lang]})
        return out


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 6000, max_grams: int = 60_000,
          longest: int = 4, penalty: float = 6.0, seed: int = 11) -> Model:
    """Fit a model on about ``sample_rows`` of the labelled ``rows``.

    Rows without text or language teach nothing.  The sample is drawn by a hash
    of the text, so that it is the same in every run; its n-grams are counted on
    the executors and the ``max_grams`` most frequent ones kept (the bound of
    the model's size).  Without any labelled row every text is ``und``.
    """
    usable = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    part = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) < int(share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for t, name in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                seen.setdefault(name, Counter()).update(w.lower() for w in pieces(t).findall(t))
            for name, words in seen.items():
                if not words:
                    continue
                often = np.fromiter(words.values(), np.int64, len(words))
                hashes, owners, firsts = gram_hashes(list(words), longest)
                grams, at = np.unique(hashes, return_inverse=True)
                scripts = np.bincount(scripts_of(firsts), often, len(SCRIPTS) + 1)
                for kind, keys, n in (("gram", grams.view(np.int64), np.bincount(at, often[owners])),
                                      ("script", np.arange(len(scripts)), scripts)):
                    yield pa.record_batch({"lang": pa.array([name] * len(keys), pa.string()), "kind": pa.array([kind] * len(keys)),
                                           "key": pa.array(keys, pa.int64()), "n": pa.array(n.astype(np.int64))})

    counts = written(usable.where(part).mapInArrow(count, "lang string, kind string, key long, n long")
                     .groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "grams")
    scripts = [(r.key, r.lang, r.n) for r in counts.where("kind = 'script' and n > 0").collect()]
    langs = sorted({name for _, name, _ in scripts})
    per_gram = counts.where("kind = 'gram'").groupBy("key").agg(
        F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{i}")
                                     for i, name in enumerate(langs)])
    top = per_gram.orderBy(F.desc("total"), "key").limit(max_grams).collect() if langs else []
    table = np.array([[r[f"n{i}"] for i in range(len(langs))] for r in top], np.float64).reshape(len(top), len(langs))
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(top))))
    weights = logs - logs.mean(axis=1, keepdims=True) if langs else logs
    seen_in = np.zeros((len(SCRIPTS) + 1, len(langs)))
    for script, name, n in scripts:
        seen_in[script, langs.index(name)] = n
    writes = seen_in > 0.001 * seen_in.sum(axis=0)
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    return Model(langs, keys, weights.astype(np.float32), writes, longest, penalty)


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and (unless left out) ``spans``.

    Runs of letters are cut at changes of script and after 64 letters, and every
    piece is scored.  ``score`` is the share of letters in spans of ``lang_pred``; a tie goes to
    the first language by name.  Null texts and texts without a letter are
    ``und`` with score 0 and no spans.  Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS if spans else RESULT)
    def label(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        values = [t if isinstance(t, str) else None for t in texts]
        if not known.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(values), "score": 0.0} | ({"spans": [[]] * len(values)} if spans else {}))
        return pd.concat([known.label(values[a:b], spans) for a, b in bounded(values, BATCH_CHARS)], ignore_index=True)

    found = docs.withColumn("_found", label(text))
    return found.select(*docs.columns, "_found.*")


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % folds
