"""Byte-level BPE over overlapping chunks.

A text up to ``chunk_chars`` is one chunk.  Longer texts are cut into
overlapping chunks, spread over tasks and pre-tokenised there.  A chunk's first
pre-tokens may be wrong, as it begins anywhere; but the pattern looks only
ahead, so from the first place where a chunk and its predecessor have the same
boundary they agree.  Each chunk is used from that place up to the same place
of its successor, its pieces are merged by rank, and the ids of a text's chunks
are put in order.  A text whose neighbours never meet inside an overlap (one
pre-token longer than it) is encoded in one go.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.batches import bounded

#: Characters before a chunk's end whose boundaries may still change with what follows.
LOOKAHEAD = 8
#: Pieces remembered in each of two generations by a task.
MEMO = 80_000
#: Characters of text that a task works on at a time.
BATCH_CHARS = 2_000_000
#: Largest vocabulary that is broadcast (entries); larger ones are refused.
MAX_RANKS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} ranks are more than the {MAX_RANKS} that are broadcast")
    return ranks


class Encoder:
    """Merges pieces by rank, remembering the pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.ranks = ranks
        # the library's own merging of one piece; pieces, chunks and stitching are ours
        self.library = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.table = pa.array(token_table(ranks), pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Repeatedly join the adjacent pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 500:
            return self._merge_long(piece)
        return tuple(self.library.encode_single_piece(piece))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list, for pieces of any length."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n

        def pair(i: int):
            j = end[i]
            return ranks.get(piece[i:end[j]]) if j < n else None

        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapify(heap)
        while heap:
            rank, i, stop = heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, text: str | None) -> list[int]:
        return self.encode_pieces(self.pattern.findall(text) if text else [])

    def ids_between(self, text: str, begin: int, end: int) -> list[int]:
        """Ids of the pieces from ``begin`` to ``end``, which are boundaries; what follows is still seen."""
        pieces = []
        for m in self.pattern.finditer(text, begin):
            if m.end() > end:
                break
            pieces.append(m[0])
        return self.encode_pieces(pieces)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        if len(self.memo) > MEMO:  # what is still in use comes over from the older half
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older.get
        for p in set(pieces).difference(memo):
            memo[p] = older(p) or self.merge(p.encode("utf-8", "replace"))
        return list(chain.from_iterable(map(memo.__getitem__, pieces)))


def cut_points(length: int, chunk_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks that cover ``length`` characters."""
    step = chunk_chars - overlap
    return [(a, min(a + chunk_chars, length)) for a in range(0, max(length - overlap, 1), step)]


def _encoder_of(spark: SparkSession, ranks_path: str, pattern: str):
    """One encoder per task: what it remembers is freed with the task, not kept by a reused worker."""
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    made: list[Encoder] = []

    def get() -> Encoder:
        if not made:
            made.append(Encoder(shared.value, pattern))
        return made[0]

    return get


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Token bytes by id."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def bytes_of_lists(given: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """The tokens' bytes of each list of ids, end to end; null lists stay null."""
    out = []
    for part in (given.slice(at, 512) for at in range(0, len(given), 512)):
        tokens = vocabulary.take(part.flatten())
        edges = np.frombuffer(tokens.buffers()[1], np.int64)[:len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        ends = np.cumsum([0] + [0 if n is None else n for n in pc.list_value_length(part).to_pylist()])
        cut, blob = edges[ends].tolist(), tokens.buffers()[2]
        whole = blob.to_pybytes() if blob is not None else b""
        out += [whole[a:b] if known else None for a, b, known in zip(cut, cut[1:], part.is_valid().to_pylist())]
    return pa.array(out, pa.binary())


def lists(rows: list[list[int]]) -> pa.ListArray:
    """Arrow lists of 32-bit ids."""
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _long_ids(texts: DataFrame, get, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(h1, h2, ids) of distinct long texts (h1, h2, t)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, t in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "t"))):
                spots = cut_points(len(t), chunk_chars, overlap)
                for no, (a, b) in enumerate(spots):
                    yield pa.record_batch({
                        "h1": pa.array([h1], pa.int64()), "h2": pa.array([h2], pa.int64()), "no": pa.array([no], pa.int32()),
                        "start": pa.array([a], pa.int64()), "last": pa.array([no == len(spots) - 1]), "part": pa.array([t[a:b]])})

    @F.pandas_udf("head array<long>, tail array<long>")
    def meet(starts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        heads, tails = [], []
        for start, part in zip(starts, parts):
            ends = [m.end() for m in get().pattern.finditer(part)]
            heads.append([start + e for e in ends if e <= overlap])
            tails.append([start + e for e in ends if len(part) - overlap <= e <= len(part) - LOOKAHEAD])
        return pd.DataFrame({"head": heads, "tail": tails})

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_between(parts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        given = zip(parts.to_pylist(), begins.to_pylist(), ends.to_pylist())
        return lists([get().ids_between(p, a, b) for p, a, b in given])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_whole(whole: pa.Array) -> pa.Array:
        return lists([get().ids(t) for t in whole.to_pylist()])

    chunks = (texts.mapInArrow(cut, "h1 long, h2 long, no int, start long, last boolean, part string")
              .repartition("h1", "h2", "no").withColumn("met", meet("start", "part")))
    order = Window.partitionBy("h1", "h2").orderBy("no")
    common = F.array_min(F.array_intersect("met.head", F.lag("met.tail").over(order)))
    stitched = chunks.withColumn("cut", F.when(F.col("no") == 0, F.lit(0)).otherwise(common))
    stitched = (stitched.withColumn("next", F.lead("cut").over(order))
                .withColumn("parted", F.count_if(F.col("cut").isNull()).over(Window.partitionBy("h1", "h2")) > 0))
    pieces = stitched.where("not parted").select("h1", "h2", "no", encode_between(
        "part", F.col("cut") - F.col("start"),
        F.coalesce(F.col("next") - F.col("start"), F.char_length("part"))).alias("ids"))
    joined = pieces.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("all"))
    joined = joined.select("h1", "h2", F.flatten(F.col("all.ids")).alias("ids"))
    whole = (texts.join(stitched.where("parted").select("h1", "h2").distinct(), ["h1", "h2"])
             .select("h1", "h2", encode_whole("t").alias("ids")))
    return joined.unionByName(whole)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
           chunk_chars: int = 1 << 16, overlap: int = 1 << 10, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the whole text; null and empty texts get an empty list.

    With ``decoded``, a column of that name holds the bytes that the ids decode
    to, made in the same pass.  Repeated rows are encoded alike; columns of
    these names are replaced.  Lone surrogates cannot occur in Spark strings.
    """
    if overlap + LOOKAHEAD >= chunk_chars:
        raise ValueError("the overlap must be smaller than a chunk")
    docs = docs.drop(ids, *([decoded] if decoded else []))
    get = _encoder_of(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("ids array<int>, bytes binary" if decoded else "ids array<int>")
    def encode_text(texts: pa.Array) -> pa.Array:
        encoder, values, parts = get(), texts.to_pylist(), []
        for a, b in bounded(values, BATCH_CHARS):
            coded = lists([encoder.ids(t) for t in values[a:b]])
            parts.append(pa.StructArray.from_arrays([coded, bytes_of_lists(coded, encoder.table)][:2 if decoded else 1],
                                                    ["ids", "bytes"][:2 if decoded else 1]))
        return pa.concat_arrays(parts)

    # declared non-deterministic so that using its fields doesn't encode twice
    encode_once = encode_text.asNondeterministic()
    size = F.coalesce(F.char_length(docs[text]), F.lit(0))
    fields = [F.col("_coded.ids").alias(ids)] + ([F.col("_coded.bytes").alias(decoded)] if decoded else [])
    short = docs.where(size <= chunk_chars).withColumn("_coded", encode_once(text)).select(*docs.columns, *fields)
    long = (docs.where(size > chunk_chars).withColumn("_h1", F.xxhash64(text))
            .withColumn("_h2", F.xxhash64(F.lit("text"), text)))
    texts = long.groupBy(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).agg(F.first(text).alias("t"))
    coded = _long_ids(texts, get, pattern, chunk_chars, overlap).withColumnRenamed("ids", "_ids")
    joined = long.join(coded, (long["_h1"] == coded["h1"]) & (long["_h2"] == coded["h2"]))
    joined = joined.select(*docs.columns, F.col("_ids").alias(ids))
    return short.unionByName(joined.withColumn(decoded, decode(docs.sparkSession, ids, ranks_path)) if decoded else joined)


def decode(spark: SparkSession, ids: Column | str, ranks_path: str) -> Column:
    """The raw bytes of a list of ids, token after token; null gives null."""
    shared = spark.sparkContext.broadcast(token_table(load_ranks(ranks_path)))

    @F.arrow_udf(T.BinaryType())
    def tokens(given: pa.Array) -> pa.Array:
        return bytes_of_lists(given, pa.array(shared.value, pa.large_binary()))

    return tokens(ids)
