"""Benchmark decontamination: windows of benchmark words found in documents.

The distinct windows of the benchmark are hashed and, while they fit a stated
bound, broadcast; each task scans the word windows of its documents with a
rolling hash and verifies every hit word by word.  A larger benchmark is not
broadcast: documents emit only windows all of whose words occur in the
benchmark's word sieve (a bitmap of fixed size), and these meet the benchmark's
windows in an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.core.shared import written

#: Letters A-Z are lowered; every other byte below 0x80 that is no digit or letter parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
HITS = "n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; null and empty texts have none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """All windows of ``size`` words; a shorter, non-empty text is one window."""
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def item_windows(benchmark: DataFrame, size: int, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) with one row per item and distinct window; repeated items fold together."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, content in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                found = sorted(windows_of(words_of(content), size))
                yield pa.record_batch({"item": pa.array([item] * len(found), pa.string()),
                                       "words": pa.array([b" ".join(w) for w in found], pa.binary())})

    given = benchmark.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return given.mapInArrow(cut, "item string, words binary").distinct()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Union of [start, start + size) as sorted disjoint spans."""
    order = np.lexsort((sizes, starts))
    out: list[tuple[int, int]] = []
    for a, n in zip(starts[order].tolist(), sizes[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


class Matcher:
    """Benchmark windows as hash sets, one per window length."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        items: dict[bytes, list[str]] = {}
        for item, words in rows:
            items.setdefault(words, []).append(item)
        self.items = items
        known = sorted({w for words in items for w in words.split()})
        self.number = {w: i + 1 for i, w in enumerate(known)}
        by_size: dict[int, list[bytes]] = {}
        for words in items:
            by_size.setdefault(words.count(b" ") + 1, []).append(words)
        self.hashes = {}
        for size, group in by_size.items():
            ids = np.array([[self.number[w] for w in words.split()] for words in group], np.uint64)
            self.hashes[size] = np.unique(self._roll(ids.ravel(), size)[::size] if size > 1 else self._roll(ids.ravel(), 1))

    @staticmethod
    def _roll(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of every window of ``size`` numbers."""
        n = len(ids) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(size):
            out = out * _PRIME + ids[i:i + n]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str | None) -> tuple[int, int, list[tuple[int, int]], list[str]]:
        """(words, words hit, spans of hit words, sorted items) of one whole text."""
        words = words_of(text)
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.uint64, len(words))
        starts, sizes, found = [], [], set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            strange = np.concatenate([[0], np.cumsum(ids == 0)])
            clean = np.nonzero(strange[size:] == strange[:-size])[0]
            if not len(clean):
                continue
            rolled = self._roll(ids, size)[clean]
            at = np.searchsorted(hashes, rolled)
            at[at == len(hashes)] = 0
            for i in clean[hashes[at] == rolled].tolist():
                items = self.items.get(b" ".join(words[i:i + size]))
                if items:
                    starts.append(i)
                    sizes.append(size)
                    found.update(items)
        spans = _spans(np.array(starts, np.int64), np.array(sizes, np.int64))
        return len(words), sum(b - a for a, b in spans), spans, sorted(found)


def _scan_broadcast(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    rows = [(r.item, bytes(r.words)) for r in windows.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    made: list[Matcher] = []

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Matcher(shared.value))
        out = [made[0].scan(t) for t in texts]
        return pd.DataFrame({
            "n_words": [o[0] for o in out], "n_hit": [o[1] for o in out],
            "hits": [[{"start": a, "end": b} for a, b in o[2]] for o in out], "items": [o[3] for o in out]})

    return docs.withColumn("_scan", scan(docs[text]))


def _sieve(windows: DataFrame, bits: int) -> bytes:
    """Bitmap of 2**bits bits with one set for every benchmark word; its size is fixed."""
    words = windows.select(F.explode(F.split(F.decode("words", "UTF-8"), " ")).alias("w")).distinct()
    # one 4 KB page of the bitmap per group of 2**15 bits
    place = F.pmod(F.xxhash64("w"), F.lit(1 << bits))
    pages = (words.select(F.floor(place / 32768).alias("page"), F.pmod(place, F.lit(32768)).alias("bit"))
             .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    out = bytearray(1 << bits - 3)
    for r in pages.toLocalIterator():
        out[r.page * 4096:(r.page + 1) * 4096] = r.bitmap
    return bytes(out)


def _scan_joined(docs: DataFrame, windows: DataFrame, text: str, size: int, bits: int = 24) -> DataFrame:
    """The same result by an equi-join on windows, for a benchmark of any size.

    Rows are known by their text's hash pair, as a window's verdict depends on nothing else.
    """
    lengths = [r[0] for r in windows.select(F.expr("size(split(decode(words, 'UTF-8'), ' '))")).distinct().collect()]
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(windows, bits))
    known = docs.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit("text"), text))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bitmap = sieve.value
        for batch in batches:
            for h1, h2, content in zip(*(batch[c].to_pylist() for c in ("_h1", "_h2", "t"))):
                words = words_of(content)
                places = [xxhash.xxh64_intdigest(w, 42) % 2**64 for w in words]
                places = [(p - 2**64 if p >> 63 else p) % (1 << bits) for p in places]
                strange = np.cumsum([0] + [not bitmap[p >> 3] >> (p & 7) & 1 for p in places])
                for n in lengths:
                    at = [i for i in range(len(words) - n + 1) if strange[i + n] == strange[i]]
                    for k in range(0, len(at), 4096):
                        part = at[k:k + 4096]
                        yield pa.record_batch({
                            "_h1": pa.array([h1] * len(part), pa.int64()), "_h2": pa.array([h2] * len(part), pa.int64()),
                            "start": pa.array(part, pa.int32()), "end": pa.array([i + n for i in part], pa.int32()),
                            "words": pa.array([b" ".join(words[i:i + n]) for i in part], pa.binary())})

    texts = known.groupBy("_h1", "_h2").agg(F.first(text).alias("t"))
    asked = texts.mapInArrow(emit, "_h1 long, _h2 long, start int, end int, words binary")
    hits = asked.join(windows, "words").groupBy("_h1", "_h2").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))

    @F.pandas_udf("n_words long, n_hit long, hits array<struct<start:int,end:int>>")
    def settle(content: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(content, spans):
            s = [] if s is None else list(s)
            starts = np.array([x["start"] for x in s], np.int64)
            joined = _spans(starts, np.array([x["end"] for x in s], np.int64) - starts)
            rows.append((len(words_of(t)), sum(b - a for a, b in joined), [{"start": a, "end": b} for a, b in joined]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "hits"])

    joined = known.join(hits.withColumnsRenamed({"_h1": "_k1", "_h2": "_k2"}),
                        F.col("_h1").eqNullSafe(F.col("_k1")) & F.col("_h2").eqNullSafe(F.col("_k2")), "left")
    done = joined.withColumn("_settled", settle(text, "spans"))
    empty = F.array().cast("array<string>")
    return done.withColumn("_scan", F.struct(
        "_settled.n_words", "_settled.n_hit", "_settled.hits", F.coalesce("items", empty).alias("items"))
    ).select(*docs.columns, "_scan")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", max_broadcast_windows: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hits`` (word spans) and ``items`` (sorted ids with a hit).

    Words lie inside an occurrence of a window of ``size`` consecutive item
    words; a shorter item is one window.  Null and empty texts have no words
    and no hits; a null item id counts as the empty string; items without
    words match nothing.  At most ``max_broadcast_windows`` windows (about 200
    bytes each) are broadcast; beyond, windows are joined.  Columns of
    ``docs`` with the names of results are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "hits", "items")
    windows = written(item_windows(benchmark, size, item_id, item_text), "windows")
    if windows.count() <= max_broadcast_windows:
        scanned = _scan_broadcast(docs, windows, text)
    else:
        scanned = _scan_joined(docs, windows, text, size)
    return scanned.select(*docs.columns, "_scan.n_words", "_scan.n_hit", "_scan.hits", "_scan.items")


def remove_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words of :func:`scan` (with what parts them) out of the texts."""
    import regex

    word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, hits):
            if t is not None and len(spans):
                at = [m.span() for m in word.finditer(t)]
                parts, end = [], 0
                for s in spans:
                    parts.append(t[end:at[s["start"]][0]])
                    end = at[s["end"] - 1][1]
                t = "".join(parts) + t[end:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(docs[text], docs["hits"]))


Decision = Callable[[DataFrame], DataFrame]


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **rule) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit spans cut out (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    clashing = {c: f"_own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "hits", "items")}
    scanned = scan(docs.withColumnsRenamed(clashing), benchmark, **rule)
    done = scanned.where("n_hit = 0") if remove == "documents" else remove_spans(scanned, rule.get("text", "text"))
    return done.drop("n_words", "n_hit", "hits", "items").withColumnsRenamed({v: k for k, v in clashing.items()})


#: DuckDB twin of the query.
ORACLE = """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (
  select distinct item, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select distinct doc_id, dw.n, i, item from dw join bw on dw.g = bw.g and dw.n = bw.n),
spots as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
found as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (doc_id) left join found using (doc_id)
"""
