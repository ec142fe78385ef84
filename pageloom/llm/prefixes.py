"""The prefix trie of conversations, node by node.

A conversation is a sequence of turns; every distinct beginning of one is a
node.  Sequences are cut into segments of ``WIDTH`` turns under the key of the
turns before them (an XOR of 128-bit hashes of position and turn), so that no
row grows with a conversation.  Segments are range-partitioned by (level, key,
first turns, conversation): a hot beginning spreads over as many shards as it
needs.  Each shard numbers its turns, fills a padded matrix of turn ids, sorts
its rows with ``numpy.lexsort``, marks where columns change, ORs the marks from
left to right, so that they show where nodes of each depth start, and
aggregates every depth with ``reduceat``, deepest first.

Only nodes on the path of a shard's first or last key can reach into another
shard.  They are partial: their sums over whole nodes below them add up, and
what they add themselves goes to their ancestors once they are recombined.
Segments under a key of a single conversation need no matrix; their nodes
follow from the rows.  Totals of deeper segments that conversations share are
carried up to their upper segment by pointer doubling, in log(depth) rounds.

Hashes of the conversations that end in a partial node are taken from a sorted
stream of id chunks, so a node's list is never held as a whole.

Defined results: rows of a conversation go by turn, null first, then by role
and text; null roles and texts are empty; rows that repeat are turns of their
own; rows without a conv_id belong to no conversation; an empty table has no
node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.ranking import ranked
from pageloom.core.shared import written

WIDTH = 32
#: Leading turns of a segment that its range key holds.
LEAD = 4
TURNS_PER_SHARD = 1 << 20
#: Rows of a conversation in one range of turns, beyond which the range is cut further.
CROWDED = 4096
HEAD_TURNS = 8
#: Ids of ending conversations in one chunk.
CHUNK = 1 << 16
_KEY = ["level", "depth", "k1", "k2"]
_BELOW = ["below_kids", "below_leaves", "below_saved"]
_PATH = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
_NODE = pa.schema([(c, pa.int32()) for c in ("level", "depth")] + [(c, pa.int64()) for c in (
    "k1", "k2", "up1", "up2", "conv_id", "parent", "n", "kids", "leaves", "saved", "size", *_BELOW)] + [
    ("partial", pa.bool_()), ("parent_partial", pa.bool_()), ("path", _PATH), ("first_end", pa.int64()), ("ends", pa.string())])
_NODE_SQL = ("level int, depth int, k1 long, k2 long, up1 long, up2 long, conv_id long, parent long, n long, kids long, leaves long, "
             "saved long, size long, below_kids long, below_leaves long, below_saved long, partial boolean, parent_partial boolean, "
             "path array<struct<k1:bigint,k2:bigint>>, first_end long, ends string")


def digest_keep(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group of five: 0 to 8."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")


def turns_of(talk: DataFrame) -> DataFrame:
    """(conv_id, p, h1, h2, size): turns by number from 1, as hashes; no conversation has to fit a task."""
    turns = talk.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / 256).alias("range"))
    crowded = turns.groupBy("conv_id", "range").count().where(F.col("count") > CROWDED)
    crowded = crowded.select(F.col("conv_id").alias("c"), F.col("range").alias("r"))
    marked = turns.join(crowded, (F.col("conv_id") == F.col("c")) & F.col("range").eqNullSafe(F.col("r")), "left")
    # a crowded range is cut further along the same order
    finer = F.when(F.col("c").isNotNull(), F.struct("turn", "role", F.substring("text", 1, 32).alias("head")))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    placed = ranked(marked, ["conv_id"], order, F.struct("range", finer.alias("finer")), "i")
    return placed.select("conv_id", F.col("i").cast("int").alias("p"), F.xxhash64("role", "text").alias("h1"),
                         F.xxhash64(F.lit("turn"), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("size"))


def regrouped(turns: DataFrame, keep: Callable[[Column], Column] = digest_keep) -> DataFrame:
    """Conversations that begin with the first turns of conversation c - c % 5 and go on with their own after as many.

    Every conversation has a row; one that comes out empty has p null.
    """
    heads = (turns.where(F.col("p") <= HEAD_TURNS).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("p", "h1", "h2", "size"))).alias("head")))
    asked = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), keep(F.col("conv_id")).alias("h"))
    given = asked.join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left")
    none = F.array().cast("array<struct<p:int,h1:bigint,h2:bigint,size:bigint>>")
    given = given.select("conv_id", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head"))
    taken = given.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.p", "t.h1", "t.h2", "t.size")
    # turns close ranks where the first conversation has fewer than were asked for
    short = given.where(F.size("head") < F.col("h")).select(F.col("conv_id").alias("c"), (F.col("h") - F.size("head")).alias("gap"))
    own = turns.where(F.col("p") > keep(F.col("conv_id"))).join(short, F.col("conv_id") == F.col("c"), "left")
    own = own.select("conv_id", (F.col("p") - F.coalesce("gap", F.lit(0))).alias("p"), "h1", "h2", "size")
    return taken.unionByName(own)


def _segments(turns: DataFrame, width: int) -> DataFrame:
    """(level, k1, k2, conv_id, seq, more, c1, c2): ``width`` turns under the key of those before; c is the next key."""
    coded = turns.select("conv_id", "p", F.when(F.col("p").isNotNull(), F.struct(
        "p", F.xxhash64("p", "h1", "h2").alias("z1"), F.xxhash64(F.lit("at"), "h2", "p", "h1").alias("z2"), "size")).alias("t"))
    level = F.coalesce(F.floor((F.col("p") - 1) / width), F.lit(0)).cast("int")
    parts = coded.groupBy("conv_id", level.alias("level")).agg(
        F.array_sort(F.collect_list("t")).alias("seq"), F.coalesce(F.bit_xor("t.z1"), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor("t.z2"), F.lit(0)).alias("x2"))
    along = Window.partitionBy("conv_id").orderBy("level")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    keyed = parts.select("conv_id", "level", "seq", "x1", "x2", F.lead("level").over(along).isNotNull().alias("more"),
                         F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("k1"),
                         F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("k2"))
    return keyed.select("level", "k1", "k2", "conv_id", "seq", "more", F.col("k1").bitwiseXOR(F.col("x1")).alias("c1"),
                        F.col("k2").bitwiseXOR(F.col("x2")).alias("c2"))


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers from 1 of the distinct rows of some columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class Shard:
    """Padded matrices of one shard's segments, rows in trie order."""

    def __init__(self, rows: pa.Table):
        seq = rows["seq"].combine_chunks()
        sizes, flat = np.asarray(seq.value_lengths(), np.int64), seq.flatten()
        z1, z2, bytes_ = (np.asarray(flat.field(f), np.int64) for f in ("z1", "z2", "size"))
        n, depth = len(sizes), int(sizes.max(initial=0))
        row, col = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        plain = {c: rows[c].to_numpy() for c in ("level", "k1", "k2", "conv_id", "more", *_BELOW)}

        def matrix(values: np.ndarray, first: int = 0) -> np.ndarray:
            out = np.zeros((n, depth + first), np.int64)
            out[row, col + first] = values
            return out

        ids, group = matrix(_numbered(z1, z2)), _numbered(plain["level"], plain["k1"], plain["k2"])
        # from the last key to the first: conversation, whether it goes on, turns, segment
        order = np.lexsort((plain["conv_id"], plain["more"], *ids.T[::-1], group))
        ids, group, self.length, self.depth = ids[order], group[order], sizes[order], depth
        self.plain = {c: v[order] for c, v in plain.items()}
        self.size, self.keys = matrix(bytes_)[order], []
        for start, z in ((plain["k1"], z1), (plain["k2"], z2)):
            z = matrix(z, 1)
            z[:, 0] = start
            self.keys.append(np.bitwise_xor.accumulate(z[order], axis=1))
        # a node starts where its column or one before it changes
        changed = np.ones((n, depth + 1), bool)
        changed[1:, 0] = group[1:] != group[:-1]
        changed[1:, 1:] = ids[1:] != ids[:-1]
        self.starts = np.logical_or.accumulate(changed, axis=1)
        # a node may reach into another shard as far as its range key is that of the first or last row
        lead = matrix(z1)[order][:, :LEAD]
        self.edge = np.zeros((n, depth + 1), bool)
        by_key = np.lexsort((*lead.T[::-1], *(self.plain[c] for c in ("k2", "k1", "level"))))
        for end in (by_key[0], by_key[-1]):
            same = np.concatenate([(group == group[end])[:, None], lead == lead[end]], axis=1)
            self.edge |= np.logical_and.accumulate(same, axis=1)[:, np.minimum(np.arange(depth + 1), lead.shape[1])]

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """Nodes, deepest first.  A partial node counts only what is whole below it."""
        n, conv, more = len(self.length), self.plain["conv_id"], self.plain["more"]
        saved, leaves, kid = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(self.depth, -1, -1):
            at = np.flatnonzero(self.starts[:, d])
            count = np.diff(np.append(at, n))
            last = at + count - 1
            goes_on = more[last] & (self.length[last] == d)
            node = {"n": count, "size": self.size[at, d - 1] if d else 0 * at, "conv_id": np.minimum.reduceat(conv, at),
                    "partial": self.edge[at, d], **{c: np.where(goes_on, self.plain[c][last], 0) for c in _BELOW}}
            kids = np.add.reduceat(kid, at)
            whole = (self.length[at] >= d) & ~node["partial"]
            node["kids"] = kids + np.where(whole, node["below_kids"], 0)
            saved[at[whole]] += ((count - 1) * node["size"] + node["below_saved"])[whole]
            leaves[at[whole]] += np.where(node["kids"] == 0, 1, node["below_leaves"])[whole]
            node |= {"saved": np.add.reduceat(saved, at), "leaves": np.add.reduceat(leaves, at)}
            upper = np.flatnonzero(self.starts[:, max(d - 1, 0)])
            above = np.searchsorted(upper, at, side="right") - 1
            node |= {"parent": np.minimum.reduceat(conv, upper)[above], "parent_partial": self.edge[at, max(d - 1, 0)]}
            kid[:] = 0
            kid[at[whole]] = 1
            yield self._batch(d, at, node)

    def _batch(self, d: int, at: np.ndarray, node: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Real nodes as rows; a partial node has its ends in chunks, each further one in a row that counts nothing."""
        ended = np.add.reduceat((self.length == d) & ~self.plain["more"], at, dtype=np.int64)
        real = np.flatnonzero(self.length[at] >= d)
        pick, first, ends = [], [], []
        for i in real.tolist():
            ids = self.plain["conv_id"][at[i]:at[i] + ended[i]]
            step = CHUNK if node["partial"][i] else max(len(ids), 1)
            for a in range(0, max(len(ids), 1), step):
                pick.append(i), first.append(int(ids[a]) if len(ids) else None)
                text = ",".join(map(str, ids[a:a + step].tolist()))
                ends.append(text if node["partial"][i] else hashlib.sha256(text.encode()).hexdigest())
        pick = np.array(pick, np.int64)
        once = np.ones(len(pick), np.int64)
        once[1:] = pick[1:] != pick[:-1]
        rows, up = at[pick], max(d - 1, 0)
        k1, k2 = self.keys
        values = {"level": self.plain["level"][rows], "depth": np.full(len(rows), d), "k1": k1[rows, d], "k2": k2[rows, d],
                  "up1": k1[rows, up], "up2": k2[rows, up], **{c: v[pick] for c, v in node.items()}}
        values |= {c: values[c] * once for c in ("n", "kids", "leaves", "saved")}
        values |= {"first_end": first, "ends": ends, "path": [
            [{"k1": a, "k2": b} for a, b in zip(k1[r, :d].tolist(), k2[r, :d].tolist())] if p else None
            for r, p in zip(rows.tolist(), values["partial"].tolist())]}
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _NODE], schema=_NODE)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        yield from Shard(pa.Table.from_batches(held)).nodes()


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of sorted chunks; one hash state and one batch are held."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]) for k in (*key, state.hexdigest())], [*_KEY, "ends_sha256"]).cast(
            pa.schema([("level", pa.int32()), ("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for *own, first, ends in zip(*(batch[c].to_pylist() for c in (*_KEY, "first_end", "ends"))):
            if own != key:
                if key is not None:
                    yield row()
                key, state, empty = own, hashlib.sha256(), True
            if first is not None:
                state.update(ends.encode() if empty else b"," + ends.encode())
                empty = False
    if key is not None:
        yield row()


def _trie(rows: DataFrame) -> DataFrame:
    """Nodes of segments (level, k1, k2, conv_id, seq, more and what is below): depth counts from the segment's key."""
    spark = rows.sparkSession
    turns = rows.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_SHARD))
    lead = [F.coalesce(F.get(F.col("seq.z1"), F.lit(i)), F.lit(0)) for i in range(LEAD)]
    ranged = rows.repartitionByRange(shards, "level", "k1", "k2", *lead, "conv_id")
    raw = written(ranged.mapInArrow(_shards, _NODE_SQL), "trie")
    partial = raw.where("partial")
    merged = partial.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")],
        *[F.max(c).alias(c) for c in ("size", *_BELOW, "up1", "up2")], F.any_value("path").alias("path"))
    merged = written(merged, "edges")
    chunks = partial.select(*_KEY, "first_end", "ends").repartition(*_KEY).sortWithinPartitions(*_KEY, F.asc_nulls_first("first_end"))
    ends = chunks.mapInArrow(_hash_streams, "level int, depth int, k1 long, k2 long, ends_sha256 string")
    joint = merged.where("depth > 0").groupBy(
        "level", (F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count(F.lit(1)).alias("joint"))
    counted = merged.join(joint, _KEY, "left").withColumn(
        "kids", F.col("kids") + F.coalesce("joint", F.lit(0)) + F.col("below_kids"))
    own = counted.select(
        "level", F.posexplode(F.concat("path", F.array(F.struct("k1", "k2")))).alias("depth", "key"),
        ((F.col("n") - 1) * F.col("size") + F.col("below_saved")).alias("own_saved"),
        F.when(F.col("kids") == 0, 1).otherwise(F.col("below_leaves")).alias("own_leaves"))
    sums = own.groupBy("level", "depth", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")).agg(
        F.sum("own_saved").alias("own_saved"), F.sum("own_leaves").alias("own_leaves"))
    parents = merged.select("level", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"),
                            F.col("conv_id").alias("parent"))
    up = ["level", "depth", "up1", "up2"]
    out = [*_KEY, "up1", "up2", "conv_id", "parent", "n", "kids", "leaves", "saved", "ends_sha256"]
    edges = (counted.join(sums, _KEY).join(ends, _KEY).join(parents, up, "left")
             .withColumn("leaves", F.col("leaves") + F.col("own_leaves")).withColumn("saved", F.col("saved") + F.col("own_saved")))
    whole = raw.where("not partial").withColumn("ends_sha256", F.col("ends"))
    inner = whole.where("not parent_partial").select(out)
    outer = whole.where("parent_partial").drop("parent").join(parents, up, "left").select(out)
    return inner.unionByName(outer).unionByName(edges.select(out))


def _below(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Segments with what ``known`` (level, k1, k2, kids, leaves, saved) says of the segments that follow them."""
    following = known.select((F.col("level") - 1).alias("level"), F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                             F.col("kids").alias("below_kids"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
    on = rows.where("more").join(following, ["level", "c1", "c2"], "left")
    end = rows.where("not more").select("*", *[F.lit(None).cast("long").alias(c) for c in _BELOW])
    return on.unionByName(end).select("level", "k1", "k2", "conv_id", "seq", "more", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _BELOW])


def _totals(shared: DataFrame, keys: DataFrame) -> DataFrame:
    """(level, k1, k2, kids, leaves, saved) of whole subtrees under the keys that several conversations share."""
    one = F.when(F.col("n") == 1, 1).otherwise(0)
    alone = keys.select("level", "k1", "k2", F.lit(1).alias("kids"), one.alias("leaves"), F.lit(0).alias("saved"))
    own = _trie(_below(shared, alone)).where("depth = 0").select("level", "k1", "k2", "kids", "leaves", "saved")
    above = shared.where("more").select((F.col("level") + 1).alias("level"), F.col("c1").alias("k1"), F.col("c2").alias("k2"),
                                        F.struct("level", "k1", "k2").alias("above")).distinct()
    totals = written(own.join(above, ["level", "k1", "k2"], "left"), "totals")
    # pointer doubling: after each round a total covers twice as many levels
    while totals.where("above is not null").limit(1).count():
        gained = totals.where("above is not null").groupBy("above").agg(F.sum("leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))
        gained = gained.select("above.*", "g_leaves", "g_saved")
        higher = totals.select(F.struct("level", "k1", "k2").alias("above"), F.col("above").alias("next"))
        totals = written(totals.join(higher, "above", "left").join(gained, ["level", "k1", "k2"], "left").select(
            "level", "k1", "k2", "kids", (F.col("leaves") + F.coalesce("g_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("g_saved", F.lit(0))).alias("saved"), F.col("next").alias("above")), "totals")
    return totals.drop("above")


def trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """Nodes of conversations (conv_id, p, h1, h2, size), p from 1 without gaps or null for an empty one.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    parts = written(_segments(turns, width), "segments")
    keys = written(parts.where("level > 0").groupBy("level", "k1", "k2").agg(F.count(F.lit(1)).alias("n"),
                                                                             F.min("conv_id").alias("first")), "keys")
    alone, common = keys.where("n = 1"), keys.where("n > 1")
    known = alone.select("level", "k1", "k2", F.lit(1).alias("kids"), F.lit(1).alias("leaves"), F.lit(0).alias("saved"))
    upper = parts.where("level = 0")
    if common.limit(1).count():
        shared = parts.where("level > 0").join(common.select("level", "k1", "k2"), ["level", "k1", "k2"], "left_semi")
        known = known.unionByName(_totals(shared, keys))
        upper = upper.unionByName(shared)
    nodes = _trie(_below(upper, known))
    # conversations may end where others go on: what follows a segment hangs on its last node, not on the next key's members
    anchors = nodes.where(F.col("depth") == width).select(
        (F.col("level") + 1).alias("level"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("anchor"))
    nodes = nodes.where("level = 0 or depth > 0")
    hanging = (F.col("level") > 0) & (F.col("depth") == 1)
    below = nodes.where(hanging).join(anchors, ["level", "up1", "up2"]).withColumn("parent", F.col("anchor"))
    depth = F.col("level") * width + F.col("depth")
    out = nodes.where(~hanging).unionByName(below.select(nodes.columns)).select(
        "conv_id", depth.cast("long").alias("depth"), F.when(depth > 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256")
    tails = parts.where("level > 0").join(alone.select("level", "k1", "k2"), ["level", "k1", "k2"], "left_semi")
    tails = tails.withColumnsRenamed({"k1": "up1", "k2": "up2"}).join(anchors, ["level", "up1", "up2"], "left")
    tails = tails.select("conv_id", "level", "more", "anchor", F.size("seq").alias("n"), F.posexplode("seq").alias("at", "turn"))
    ends = (F.col("at") == F.col("n") - 1) & ~F.col("more")
    parent = F.when(F.col("at") == 0, F.coalesce("anchor", "conv_id")).otherwise(F.col("conv_id"))
    return out.unionByName(tails.select(
        "conv_id", (F.col("level") * width + F.col("at") + 1).cast("long").alias("depth"), parent.alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(ends, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256")))


def conversation_trie(talk: DataFrame, width: int = WIDTH) -> DataFrame:
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(regrouped(written(turns_of(talk), "turns")), width)


#: DuckDB twin of the query; the nested reductions are CRC-32, bit by bit.
ORACLE = """
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as (select conv_id, list({'role': role, 'text': text} order by i) as own from t group by conv_id),
h as (
  select conv_id, own, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                                      lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))) % 9 as h
  from c),
s as (
  select h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) as seq
  from h left join c b on b.conv_id = h.conv_id - h.conv_id % 5),
m as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from s),
node as (
  select seq[1:d] as path, d, min(conv_id) as conv_id, count(*) as n,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(seq) = d), '') as ends
  from m group by seq[1:d], d),
kid as (select path[1:d - 1] as path, count(*) as kids from node where d > 0 group by path[1:d - 1]),
up as (
  select path[1:a] as path, a, count(*) filter (where leaf) as leaves, sum(saved) as saved
  from (select n.path, kids is null as leaf, (n.n - 1) * coalesce(strlen(n.path[n.d].text), 0) as saved,
               unnest(range(0, n.d + 1)) as a
        from node n left join kid k on n.path = k.path)
  group by path[1:a], a)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.kids, 0) as n_children,
       u.leaves as n_leaves, cast(u.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from node n join up u on n.path = u.path left join kid k on n.path = k.path
left join node p on n.d > 0 and p.path = n.path[1:n.d - 1]
"""
