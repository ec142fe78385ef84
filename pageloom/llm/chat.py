"""Chat formatting by perspective rotation.

Every participant of a conversation gets its own rendering: its messages as the
assistant's, all others' as those of named users, system messages as they are.
The mask lists the character ranges to learn from: the perspective's own words
and their end marks.  A rendering is cut into parts of ``block_turns`` turns,
so that a conversation of any length is spread over rows of bounded size;
joined in order of ``part`` they are the whole dialogue.  Messages cross the
network once.  Only ranges of turns that hold very many messages (tied or null
turns, a null conversation) are ranked first and cut by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core.ranking import running_sum
from pageloom.core.shared import written

START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
UNNAMED = "unknown"


def clean(text: Column) -> Column:
    """Text without chat marks of its own: ``<|`` gets a space in between; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _recut(spoken: DataFrame, most: int) -> DataFrame:
    """``spoken`` with ``copies`` of equal messages, and ranges of more than ``most`` messages cut by rank into parts.

    Parts after such a range move up by the parts it was cut into besides its
    first.  The messages of full ranges, equal ones folded, are dealt out by
    their order, so neither a conversation nor a turn lands in one task.
    """
    plain = spoken.withColumn("copies", F.lit(1).cast("long"))
    full = written(spoken.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
                   .select(F.struct("conv_id").alias("_g"), F.col("part").alias("_p"), "n"), "full")
    if full.isEmpty():
        return plain
    group = [F.struct("conv_id") == F.col("_g"), F.col("part") == F.col("_p")]
    calm = plain.join(F.broadcast(full), group[0] & group[1], "left_anti")
    held = spoken.join(F.broadcast(full), group[0] & group[1], "left_semi")
    order = ["conv_id", "part", "turn", "role", "text"]
    folded = held.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
    tasks = max(2, int(spoken.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(folded.repartitionByRange(tasks, *order).withColumn("_task", F.spark_partition_id())
                    .withColumn("_group", F.struct("conv_id")), "dealt")
    placed = running_sum(dealt, ["_group", "part"], [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")],
                         F.col("_task"), F.col("copies"), "_before")
    last = F.col("_before") + F.col("copies") - 1
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_before") / most), F.floor(last / most))))
    cut = pieces.select(
        "conv_id", "turn", "role", "text", "part", "_piece",
        (F.least(last, (F.col("_piece") + 1) * most - 1) - F.greatest("_before", F.col("_piece") * most) + 1).alias("copies"))
    # How far each range of a conversation with full ranges moves up: it meets the few full ranges only.
    ranges = spoken.select(F.struct("conv_id").alias("_r"), F.col("part").alias("_q")).distinct()
    moved = (ranges.join(F.broadcast(full), (F.col("_r") == F.col("_g")) & (F.col("_q") > F.col("_p")))
             .groupBy("_r", "_q").agg(F.sum(F.floor((F.col("n") - 1) / most)).alias("up")))
    both = calm.withColumn("_piece", F.lit(0).cast("long")).unionByName(cut)
    return (both.join(moved, (F.struct("conv_id") == F.col("_r")) & (F.col("part") == F.col("_q")), "left")
            .select("conv_id", "turn", "role", "text", "copies", (F.col("part") + F.col("_piece") + F.coalesce("up", F.lit(0))).alias("part")))


def rotate(messages: DataFrame, block_turns: int = 256, system: str = "system", most: int = 1024) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask) from (conv_id, turn, role, text).

    Messages stand by turn; equal turns by role, then text (nulls first), and
    repeated rows appear as often as they came.  A null role is the participant
    ``unknown``, a null turn comes before all (in part -1), a null conversation
    id is one conversation.  A range of ``block_turns`` turns with more than
    ``most`` messages is cut into parts of ``most``, numbered on from its first.  A conversation of system messages only has no
    participant and no row; an empty table gives an empty result; other
    columns are not read.
    """
    spoken = messages.select(
        "conv_id", "turn", F.when(F.col("role").isNull(), UNNAMED).otherwise(clean(F.col("role"))).alias("role"),
        clean(F.col("text")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long").alias("part"))
    spoken = _recut(spoken, most)
    people = (spoken.where(F.col("role") != system).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective"))
              .distinct())
    parts = spoken.select(F.col("conv_id").alias("_b"), F.col("part").alias("_p")).distinct()
    wanted = parts.join(people, F.col("_b").eqNullSafe(F.col("_c"))).select("_b", "_p", "perspective")
    blocks = spoken.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("messages"))
    # Equal messages that were folded stand as often as they came.
    blocks = blocks.withColumn("messages", F.when(F.exists("messages", lambda m: m["copies"] > 1), F.flatten(F.transform(
        "messages", lambda m: F.array_repeat(m, m["copies"].cast("int"))))).otherwise(F.col("messages")))
    faced = blocks.join(wanted, F.col("conv_id").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")))
    own = F.col("perspective")

    def opening(m: Column) -> Column:
        name = F.when(m["role"] == own, F.lit("assistant")).when(m["role"] == system, F.lit(system))
        return F.concat(F.lit(START), name.otherwise(F.concat(F.lit("user name="), m["role"])), F.lit(LINE))

    cut = F.transform("messages", lambda m: F.struct(
        opening(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == own).alias("own")))
    laid = faced.withColumn("_cut", cut)
    ranges = F.aggregate(
        "_cut", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len(LINE)).alias("at"),
            F.when(x["own"], F.concat(acc["mask"], F.array(F.struct(
                (acc["at"] + F.char_length(x["head"])).alias("start"),
                (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"])).alias("end")))))
            .otherwise(acc["mask"]).alias("mask")),
        lambda acc: acc["mask"])
    text = F.array_join(F.transform("_cut", lambda x: F.concat(x["head"], x["body"], F.lit(LINE))), "")
    return laid.select("conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_turns"),
                       text.alias("text"), ranges.alias("mask"))


#: DuckDB twin of the query.
ORACLE = """
with m as (
  select conv_id, turn, coalesce(replace(role, '<|', '< |'), 'unknown') as role,
         replace(coalesce(text, ''), '<|', '< |') as text, coalesce(cast(floor(turn / 256) as bigint), -1) as part
  from conversations),
people as (select distinct conv_id, role as perspective from m where role <> 'system'),
laid as (
  select m.conv_id, part, perspective, turn, role, text,
         '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
                                else 'user name=' || role end || chr(10) as head,
         text || '<|im_end|>' as body
  from m join people p on m.conv_id is not distinct from p.conv_id),
placed as (
  select *, row_number() over w as seq,
         sum(length(head) + length(body) + 1) over w - length(body) - 1 as s
  from laid window w as (partition by conv_id, perspective, part order by turn nulls first, role, text
                         rows between unbounded preceding and current row))
select conv_id, perspective, part, count(*) as n_turns,
       cast(sum(length(head) + length(body) + 1) as bigint) as n_chars,
       cast(coalesce(sum(length(body)) filter (where role = perspective), 0) as bigint) as n_masked,
       coalesce(string_agg(cast(s as bigint) || '-' || cast(s + length(body) as bigint), ',' order by seq)
                filter (where role = perspective), '') as mask,
       sha256(string_agg(head || body || chr(10), '' order by seq)) as text_sha256
from placed group by conv_id, perspective, part
"""
