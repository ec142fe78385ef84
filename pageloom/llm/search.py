"""Ranked lexical search: the best documents of every item by exact term scores.

Documents are tokenised once into a forward table that holds only terms of the
items.  Counts over all documents give every term's weight.  Each task then
turns blocks of documents into impact lists (per term, highest score first) and
runs the Best Position Algorithm on them: the lists are read side by side; every
document met is looked up in all other lists of the item, and each list keeps
which of its positions have been seen so, and up to where without a gap.  A
document that was not met stands behind that best position in every list, so
the scores found there bound its sum, and more tightly than the positions last
read.  A search stops when the bound is strictly below the kth score found;
an equal score may still belong to a smaller id.  The kth score of a task's
earlier blocks counts as well.

Items are broadcast in slices of at most ``max_slice_bytes``; each slice takes
a pass of its own, so a larger set of items costs passes, not memory.

Defined results: a null text has no terms, and documents without terms do not
count; rows that repeat are documents of their own and equal scores go by
ascending id, null first; rows of one item id, null included, are one item with
all their terms; an item without terms, or none of whose terms is found, has no
rows, as has an empty table.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.shared import written
from pageloom.llm.batches import bounded

#: Letters A-Z are lowered; every other byte below 0x80 that is no digit or letter parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Documents and postings in one block of impact lists; a longer document is a block of its own.
BLOCK_ROWS, BLOCK_POSTINGS = 1 << 15, 1 << 20
FIRST_STEP = 64
BATCH_CHARS = 2_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """Terms by number, and the numbers of each item's distinct terms."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.number: dict[bytes, int] = {}
        found: dict[object, set[int]] = {}
        for item, text in rows:
            own = found.setdefault(item, set())
            own.update(self.number.setdefault(t, len(self.number)) for t in set(terms_of(text)))
        self.ids = list(found)
        self.terms = [np.array(sorted(own), np.int64) for own in found.values()]


def _forward(docs: DataFrame, shared) -> DataFrame:
    """(id, n, terms, tfs) of documents with terms: their length, and the item terms in them."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in bounded(texts, BATCH_CHARS):
                row, size, terms, tfs = [], [], [], []
                for i in range(a, b):
                    words = terms_of(texts[i])
                    if words:
                        counts = Counter(filter(number.__contains__, words))
                        row.append(i), size.append(len(words))
                        terms.append([number[w] for w in counts]), tfs.append(list(counts.values()))
                yield pa.record_batch({"id": batch["id"].take(pa.array(row, pa.int64())), "n": pa.array(size, pa.int64()),
                                       "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(read, f"id {kind}, n long, terms array<int>, tfs array<long>")


def weights(forward: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) by term number."""
    out = np.zeros(n_terms, np.int64)
    for term, df in forward.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


class Lists:
    """Impact lists of a block: per term by score, and by document for direct access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        scored = impact > 0
        term, doc, impact = term[scored], doc[scored], impact[scored]
        by_impact = np.lexsort((doc, -impact, term))
        by_doc = np.lexsort((doc, term))
        place = np.empty(len(term), np.int64)
        place[by_impact] = np.arange(len(term))
        self.docs, self.impacts = doc[by_impact], impact[by_impact]
        self.sorted_docs, self.sorted_impacts, self.places = doc[by_doc], impact[by_doc], place[by_doc]
        known, starts = np.unique(term[by_doc], return_index=True)
        self.edges = dict(zip(known.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)])))


class Search:
    """Best Position Algorithm over one block's lists of one item."""

    def __init__(self, lists: Lists, terms: np.ndarray, n_docs: int):
        self.lists, self.edges = lists, [lists.edges[t] for t in terms.tolist() if t in lists.edges]
        self.seen = [np.zeros(b - a, bool) for a, b in self.edges]
        self.best = [0] * len(self.edges)
        self.met = np.zeros(n_docs, bool)
        self.read = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs`` by direct access; where they stand counts as seen."""
        out = np.zeros(len(docs), np.int64)
        for (a, b), seen in zip(self.edges, self.seen):
            at = np.searchsorted(self.lists.sorted_docs[a:b], docs)
            at[at == b - a] = 0
            hit = self.lists.sorted_docs[a:b][at] == docs
            at = at[hit] + a
            out[hit] += self.lists.sorted_impacts[at]
            seen[self.lists.places[at] - a] = True
        return out

    def bound(self) -> int:
        """No document that was not met scores more: the sum of what follows the best positions."""
        total = 0
        for i, ((a, b), seen) in enumerate(zip(self.edges, self.seen)):
            rest = seen[self.best[i]:]
            gap = int(np.argmin(rest)) if len(rest) else 0
            self.best[i] += len(rest) if len(rest) and rest[gap] else gap
            if a + self.best[i] < b:
                total += int(self.lists.impacts[a + self.best[i]])
        return total

    def top(self, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): among them are the k best of those that score ``floor`` or more."""
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, FIRST_STEP
        while self.edges:
            new = [self.lists.docs[a + at:min(a + at + step, b)] for a, b in self.edges if a + at < b]
            new = np.unique(np.concatenate(new)) if new else docs[:0]
            new = new[~self.met[new]]
            self.met[new] = True
            self.read += len(new)
            docs, found = np.concatenate([docs, new]), np.concatenate([found, self.scores(new)])
            kth = floor
            if len(found) > k:
                kth = max(kth, int(np.partition(found, -k)[-k]))
                docs, found = docs[found >= kth], found[found >= kth]
            elif len(found) == k:
                kth = max(kth, int(found.min()))
            bound = self.bound()
            if bound == 0 or bound < kth:
                break
            at, step = at + step, step * 2
        return docs, found


class Best:
    """The k best of an item so far: scores, whether an id is given, and ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def floor(self) -> int:
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, known, ids], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:self.k]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch["terms"].value_lengths().fill_null(0)))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, before + BLOCK_POSTINGS - postings, side="right"))
            upto = min(max(fit, at + (not held)), at + BLOCK_ROWS - rows, len(batch))
            if upto > at:
                held.append(batch.slice(at, upto - at))
                rows, postings, at = rows + upto - at, postings + int(ends[upto - 1] - before), upto
            if at < len(batch):
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _lists(block: pa.Table, weight: np.ndarray, n_docs: int, n_terms: int) -> Lists:
    terms, tfs = (block[c].combine_chunks() for c in ("terms", "tfs"))
    doc = np.repeat(np.arange(len(terms)), np.asarray(terms.value_lengths()))
    term, tf = np.asarray(terms.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
    # whole numbers of any size: lengths times counts may leave 64 bits
    m = np.array([50 + 50 * n * n_docs // n_terms for n in block["n"].to_pylist()], np.int64)
    return Lists(term, doc, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", max_slice_bytes: int = 1 << 25) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    given = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-size // max_slice_bytes))
    parts = [_found(given, asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == s), k) for s in range(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")


def _found(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """One slice of items against all documents."""
    spark = docs.sparkSession
    items = Items([tuple(r) for r in asked.toLocalIterator()])
    shared = spark.sparkContext.broadcast(items)
    forward = written(_forward(docs, shared), "forward")
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranked_by = spark.sparkContext.broadcast(weights(forward, len(items.number), n_docs))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in shared.value.ids]
        for block in _blocks(batches):
            lists = _lists(block, ranked_by.value, n_docs, n_terms)
            known = np.asarray(block["id"].is_valid().to_numpy(), np.int64)
            ids = block["id"].fill_null(0).to_numpy().astype(np.int64)
            for best, terms in zip(found, shared.value.terms):
                rows, scores = Search(lists, terms, len(ids)).top(k, best.floor)
                best.add(scores, known[rows], ids[rows])
        task = TaskContext.get().partitionId()
        for no, best in enumerate(found):
            if len(best.rows):
                yield pa.record_batch({
                    "no": pa.array([no] * len(best.rows), pa.int32()), "task": pa.array([task] * len(best.rows), pa.int32()),
                    "id": pa.array(best.rows[:, 2], pa.int64(), mask=best.rows[:, 1] == 0), "score": pa.array(best.rows[:, 0])})

    tops = forward.mapInArrow(best, "no int, task int, id long, score long")
    # two steps, so that one task never meets an item's best of all tasks
    by_score = [F.desc("score"), F.asc_nulls_first("id")]
    near = Window.partitionBy("no", F.floor(F.col("task") / 256)).orderBy(*by_score)
    whole = Window.partitionBy("no").orderBy(*by_score)
    tops = tops.withColumn("near", F.row_number().over(near)).where(F.col("near") <= k)
    tops = tops.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    kind = asked.schema["item"].dataType.simpleString()
    names = spark.createDataFrame([(n, i) for n, i in enumerate(items.ids)], f"no int, item {kind}")
    return tops.join(names, "no").select("item", "rank", "id", "score")


#: DuckDB twin of the query.
ORACLE = r"""
with d as (
  select row_number() over () as row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
held as (select row_no, doc_id, len(terms) as n, terms from d where len(terms) > 0),
total as (select count(*) as n_docs, cast(sum(n) as hugeint) as n_terms from held),
item as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
tf as (
  select row_no, doc_id, n, term, count(*) as tf
  from (select row_no, doc_id, n, unnest(terms) as term from held) where term in (select term from item)
  group by all),
w as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from tf, total group by term, n_docs),
scored as (
  select item_id, row_no, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + cast((50 * n * n_docs) // n_terms as bigint))))) as score
  from item join w using (term) join tf using (term) cross join total group by item_id, row_no, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from scored where score > 0)
where rank <= 50
"""
