"""SimHash near-duplicates through Golay-coded keys.

A fingerprint is cut into segments A (23 bits), B (23) and C (18, padded to 23
with zeros).  The binary Golay code [23, 12, 7] is perfect: every 23-bit word
lies within 3 flips of exactly one codeword, so a segment *decodes* to a 12-bit
index, and the 24 words within one flip of it decode to 1 or 6 indices.  If two
segments differ in at most one bit, the index of the one is among the nearby
indices of the other.

Pigeonhole over at most 3 flips: either some segment is equal and another
differs in at most one bit, or each segment has exactly one flip.

* Six *near* tables, one per ordered pair of segments: key = the equal segment
  whole and the Golay index of the other (30 or 35 bits).  The index side files
  one key per fingerprint, the query side the 1 or 6 nearby ones.
* Eight *half* tables for one flip in each segment: every segment is halved and
  one half of each must be equal (about 32 bits).

Equal fingerprints are folded together first, so exact copies cost one row.
Candidates of a key are verified with ``bit_count(a xor b) <= 3``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.core.shared import written
from pageloom.llm.graph import components

SEED = 42
MAX_FLIPS = 3
#: (lowest bit, width) of the segments A, B, C.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text as an unsigned integer (0 without words)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> Column:
    """Column of signed 64-bit fingerprints of ``docs[text]``.

    A-Z is lower-cased, words are runs without ASCII white space, shingles keep
    repeats; a shorter text is one shingle, a text without words (or null)
    has fingerprint 0.
    """
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return of(docs[text])


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of each syndrome."""
    def remainder(word: int) -> int:
        for shift in range(22, 10, -1):
            if word >> shift & 1:
                word ^= GOLAY << (shift - 11)
        return word

    bit = [remainder(1 << i) for i in range(23)]

    def spread(first: int, width: int) -> np.ndarray:
        table = np.zeros(1 << width, np.int64)
        for i in range(width):
            table[1 << i: 2 << i] = table[: 1 << i] ^ bit[first + i]
        return table

    errors = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                flips = {a, b, c}
                word = 0
                syndrome = 0
                for i in flips:
                    word |= 1 << i
                    syndrome ^= bit[i]
                errors[syndrome] = word
    return spread(0, 12), spread(12, 11), errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = golay_tables()
    words = words.astype(np.int64)
    fixed = words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]
    return fixed >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24) indices of each word and of its 23 neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)
    return golay_index(words.astype(np.int64)[:, None] ^ flips[None, :])


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, side) for all tables; side 0 files, side 1 asks, side 2 does both.

    The table's number is in the key's top bits.
    """
    segments = _segments(fps)
    row = np.arange(len(fps), dtype=np.int64)
    rows, keys, sides = [], [], []
    filed = [golay_index(s) for s in segments]
    asked = []
    for s in segments:
        near = np.sort(nearby_indices(s), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        asked.append((np.nonzero(fresh)[0], near[fresh]))
    table = 0
    for equal in range(3):
        for near in range(3):
            if near == equal:
                continue
            top = table << 40
            rows.append(row)
            keys.append(top | segments[equal] << 12 | filed[near])
            sides.append(np.zeros(len(row), np.int8))
            at, index = asked[near]
            rows.append(at)
            keys.append(top | segments[equal][at] << 12 | index)
            sides.append(np.ones(len(at), np.int8))
            table += 1
    halves = [((s & 0xFFF), (s >> 12)) if width == 23 else ((s & 0x1FF), (s >> 9))
              for s, (_, width) in zip(segments, SEGMENTS)]
    for choice in range(8):
        key = np.full(len(fps), table << 40, np.int64)
        shift = 0
        for i, parts in enumerate(halves):
            key |= parts[choice >> i & 1] << shift
            shift += 12
        rows.append(row)
        keys.append(key)
        sides.append(np.full(len(row), 2, np.int8))
        table += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


#: Bits that two fingerprints under one key of a table may differ in.
def _free_bits() -> list[list[int]]:
    out = []
    for equal in range(3):
        at, width = SEGMENTS[equal]
        rest = [b for b in range(64) if not at <= b < at + width]
        out += [rest, rest]
    for choice in range(8):
        free = []
        for i, (at, width) in enumerate(SEGMENTS):
            half = 12 if width == 23 else 9
            fixed = range(at, at + half) if not choice >> i & 1 else range(at + half, at + width)
            free += [b for b in range(at, at + width) if b not in fixed]
        out.append(free)
    return out


def _file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), 2048):
            part = fps[at:at + 2048]
            rows, keys, sides = keys_of(part)
            yield pd.DataFrame({"key": keys, "fp": part[rows], "side": sides})


def _centres(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word within two flips (in the key's free bits) of a fingerprint."""
    free = _free_bits()
    flips = []
    for bits in free:
        one = np.array([1 << b for b in bits], np.uint64)
        a, b = np.triu_indices(len(one), 1)
        flips.append((np.concatenate([[np.uint64(0)], one]), one[a] ^ one[b]))
    for batch in batches:
        for key, fp in zip(batch["key"].tolist(), batch["fp"].tolist()):
            near, far = flips[key >> 40]
            word = np.uint64(fp & (1 << 64) - 1)
            centre = np.concatenate([near, far]) ^ word
            yield pd.DataFrame({"key": key, "fp": fp, "centre": centre.view(np.int64),
                                "near": np.arange(len(centre)) < len(near)})


def links(distinct_fps: DataFrame, dense: int = 1024) -> DataFrame:
    """Edges (a, b) between fingerprints at 1 to 3 flips, enough to connect every such pair.

    A key filed by up to ``dense`` fingerprints compares its members one by
    one.  A fuller key is not compared pairwise: each member names the words
    within two flips of it; two members within three flips share a word that is
    at most one flip from the one and two from the other.  All members within
    one flip of a word are within two of each other, so a star around the
    smallest of them, joined by all members within two flips, holds only true
    links and connects all.  Rows stay in proportion to the members.

    A fingerprint becomes some sixty rows here, which Spark sizes as one: the
    grown tables are never broadcast.
    """
    keyed = distinct_fps.select("fp").mapInPandas(_file, "key long, fp long, side byte")
    full = (keyed.where("side <> 1").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > dense).select("key"))
    sparse = keyed.join(full, "key", "left_anti")
    filed = sparse.where("side <> 1").select("key", F.col("fp").alias("a"))
    asked = sparse.where("side <> 0").select("key", F.col("fp").alias("b"))
    flips = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = filed.hint("merge").join(asked, "key").where((F.col("a") != F.col("b")) & (flips <= MAX_FLIPS)).select("a", "b")
    balls = (keyed.join(full, "key", "left_semi").select("key", "fp").distinct()
             .mapInPandas(_centres, "key long, fp long, centre long, near boolean"))
    hubs = balls.where("near").groupBy("key", "centre").agg(F.min("fp").alias("b"))
    stars = balls.hint("merge").join(hubs, ["key", "centre"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3,
                    dense: int = 1024) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most three
    flips, the row itself included.  Null texts and texts without words share
    fingerprint 0.  Null ids take part but are never the smallest unless the
    whole component has none; repeated rows come back as often as they came.
    An empty table gives an empty result; other columns are not read.
    """
    own = written(docs.select(docs[id].alias("id"), fingerprints(docs, text, width).alias("fp")), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, dense))
    placed = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id), "fp", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest id.

    Rows equal in id and fingerprint are copies of each other; one stays.
    """
    groups = near_duplicates(docs, id, text)
    keepers = (groups.groupBy("component_id")
               .agg(F.min(F.struct(F.col(id).isNull().alias("no"), F.col(id).alias("id"), "fp")).alias("k"))
               .select(F.col("k.id").alias("_id"), F.col("k.fp").alias("_fp")))
    marked = docs.withColumn("_mark", fingerprints(docs, text))
    joined = marked.join(keepers, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_fp")))
    from pyspark.sql import Window
    first = F.row_number().over(Window.partitionBy("_id", "_fp").orderBy(F.xxhash64(text)))
    return joined.withColumn("_first", first).where("_first = 1").select(*docs.columns)
