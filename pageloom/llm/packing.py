"""Packing of tokenised documents into training sequences of a fixed length.

Texts become token ids with an end id behind them.  Only documents longer than
a sequence are cut, from the back: all their pieces but the first are full.
Full pieces are sequences as they stand.  The others meet a bounded-space
online best fit: each task takes a stream of about ``PER_TASK`` pieces in
pseudo-random order, of which windows of ``WINDOW`` arrive longest first, and
keeps a fixed number of open bins in a bitset keyed by free space.  A piece
goes into the bin that it fills most; where none has room and all bins are
open, the fullest closes for good.

A task holds its open bins and a window, nothing else, whatever its stream's length.
The stream's order follows from the rows alone, so a task that runs again
packs alike.  Defined results: a null or empty text is the end id alone; rows
that repeat, null ids included, are documents of their own; an empty table
gives no rows.  Other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pageloom.core.shared import written
from pageloom.llm.batches import bounded

OPEN_BINS = 1024
#: Pieces in one task's stream: the open bins at its end are what splitting the work costs.
PER_TASK = 1 << 15
#: Pieces that are put in order of length before they arrive.
WINDOW = 2048
#: Pre-tokens remembered by a worker (twice as many while the older half is still used).
MEMO = 400_000
BATCH_CHARS, RUN = 1_000_000, 100_000
#: Latin letters end here.
QUICK = 0x250


class Remembered(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit bytes, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = self.make(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = found
        return found

    def age(self) -> None:
        """Forget what was not used since the last time."""
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


def merges_by_id(definition: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if the definition is byte-level and its merges run in order of id.

    Then merging the pair of least id is the same as merging by the list.
    """
    model, before = definition["model"], definition["pre_tokenizer"] or {}
    vocab, merges = model["vocab"], model["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    merged = [vocab.get(a + b) for a, b in pairs]
    plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
             and not definition["normalizer"] and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and not model.get("dropout") and None not in merged and merged == sorted(merged)
             and sorted(merged) == sorted(set(vocab.values()) - {vocab[t] for t in vocab if len(t) == 1}))
    if not plain:
        return None
    # byte-level vocabularies write a byte as a printable character
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(shown)))}
    return {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if set(token) <= byte.keys()}


class Coder:
    """Token ids of texts, pre-token by pre-token."""

    def __init__(self, definition: str, pattern: str, quick: tuple[str, str] | None = None):
        known = json.loads(definition)
        added = {t["content"]: t["id"] for t in known.get("added_tokens", [])}
        ranks = merges_by_id(known | {"model": known["model"] | {"vocab": {
            t: i for t, i in known["model"]["vocab"].items() if t not in added}}})
        if ranks:
            merged = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
            make = lambda piece: merged.encode_single_piece(piece.encode())
        else:
            library = Tokenizer.from_str(definition)
            make = lambda piece: library.encode(piece, add_special_tokens=False).ids
        self.memo, self.pattern = Remembered(make), regex.compile(pattern)
        self.special = {t: struct.pack("<I", i) for t, i in added.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.quick = (re.compile(quick[0]), re.compile(quick[1])) if quick else None

    def _plain(self, text: str) -> bytes:
        pattern = self.quick[0] if self.quick and not self.quick[1].search(text) else self.pattern
        self.memo.age()
        if len(text) <= BATCH_CHARS:
            return b"".join(map(self.memo.__getitem__, pattern.findall(text)))
        matches, out = pattern.finditer(text), []
        while run := [m[0] for m in islice(matches, RUN)]:
            self.memo.age()
            out.append(b"".join(map(self.memo.__getitem__, run)))
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text; the vocabulary's added tokens are found first, as its library does."""
        out, at = [], 0
        for m in self.at_special.finditer(text or ""):
            out += [self._plain(text[at:m.start()]), self.special[m[0]]]
            at = m.end()
        out.append(self._plain((text or "")[at:]))
        return b"".join(out)


def quick_pattern(pattern: str) -> tuple[str, str] | None:
    """``pattern`` for the faster standard library, and a class of characters that ask for the slower one.

    The class holds all beyond ``QUICK`` and those before it that the two libraries see differently.
    """
    every, differ, out = "".join(map(chr, range(QUICK))), set(), pattern
    for theirs, ours in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        differ.update(set(regex.findall(theirs, every)) ^ set(re.findall(ours, every)))
        out = out.replace(theirs, ours)
    return None if r"\p" in out else (out, f"[{chr(QUICK)}-{chr(0x10FFFF)}{''.join(map(re.escape, sorted(differ)))}]")


_coders: dict[tuple, Coder] = {}


def _coder(*given) -> Coder:
    """One per worker process, whose memory it bounds."""
    if given not in _coders:
        _coders.clear()
        _coders[given] = Coder(*given)
    return _coders[given]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end: int, capacity: int = 1024, id: str = "doc_id",
           text: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) and, on demand, the ids of every piece of every document.

    ``pattern`` parts a text into the runs that the tokenizer's merges never cross.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern, quick_pattern(pattern)))
    given = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    last = np.array([end], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in bounded(texts, BATCH_CHARS):
                row, no, start, length, crc, kept = [], [], [], [], [], []
                for i in range(a, b):
                    coded = coder.ids(texts[i]) + last
                    for k, (at, n) in enumerate(cuts(len(coded) // 4, capacity)):
                        part = coded[4 * at:4 * (at + n)]
                        row.append(i), no.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(part))
                        if ids:
                            kept.append(np.frombuffer(part, "<u4"))
                columns = {"id": batch["id"].take(pa.array(row, pa.int64())), "piece": pa.array(no, pa.int32()),
                           "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                           "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.record_batch(columns)

    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return given.mapInArrow(code, schema).withColumnRenamed("id", id)


class OpenBins:
    """At most ``limit`` open bins; bit f of ``mask`` stands while some of them has f places free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.open, self.made, self.mask = capacity, limit, 0, 0, 0
        self.with_free: list[deque[int]] = [deque() for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        """The oldest of the bins with that much free space."""
        bins = self.with_free[free]
        found = bins.popleft()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return found

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the fullest open bin with room, else a new one."""
        if not 0 < need <= self.capacity:
            raise ValueError(f"a piece of {need} does not fit a sequence of {self.capacity}")
        roomy = self.mask >> need
        if roomy:
            free = need + (roomy & -roomy).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        left = free - need
        if left:
            self.with_free[left].append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack(cut: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """``cut``, read twice and so a written table, with ``sequence_id`` and ``offset``.

    Sequence ids are unique, with gaps; those of full pieces are negative.
    """
    short = cut.where(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // per_task))
    mixed = F.xxhash64(*[c for c in cut.columns if c != "ids"])
    streams = short.repartition(tasks).sortWithinPartitions(mixed, *[c for c in cut.columns if c != "ids"])
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch["length"].to_numpy()
            found = np.zeros((len(lengths), 2), np.int64)
            for at in range(0, len(lengths), WINDOW):
                arriving = at + np.argsort(-lengths[at:at + WINDOW], kind="stable")
                found[arriving] = [bins.place(n) for n in lengths[arriving].tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found[:, 0] + (task << 40)), pa.array(found[:, 1])], schema.names)

    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return streams.mapInArrow(fit, schema).unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end: int, capacity: int = 1024, id: str = "doc_id",
                   text: str = "text", ids: bool = False, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """Every piece of every document with its sequence and its place there.  Texts are tokenised once."""
    cut = written(pieces(docs, tokenizer_path, pattern, end, capacity, id, text, ids), "pieces")
    return pack(cut, capacity, open_bins, per_task)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
