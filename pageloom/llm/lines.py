"""Line de-duplication over range-partitioned line hashes.

Only 128-bit hashes of long lines travel.  They are range-partitioned by
(hash, salt), the salt being a small hash of the document, so that one very
common line is cut over many ranges; inside a range they are sorted by hash,
document (largest first) and position, and a stream over that order counts
documents and meets the keeper first.  The few totals of a hash are then added
up, and what is dropped comes back per document as run-length coded line
ranges to keep: the text is never shuffled for the decision itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.core.shared import written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The text cut at \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _rows_known(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows by id and content: rows equal in both share every decision."""
    content = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id].alias("id"), F.xxhash64(content).alias("version"), lines_of(docs[text]).alias("lines"))


def keep_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40,
              min_docs: int = 5, salts: int = 16) -> DataFrame:
    """(id, version, n_dropped, dropped) of the rows that lose lines.

    A key of at least ``min_chars`` code points that occurs in at least
    ``min_docs`` documents keeps its lines only in the document with the
    largest id (a null id counts as one document below all others).
    ``dropped`` is the sorted list of 0-based line numbers; ``version`` tells
    rows of a repeated id apart by their text.  Empty tables, texts and lines
    give no rows; columns other than id and text are not read.
    """
    lines = _rows_known(docs, id, text).select("id", "version", F.posexplode("lines").alias("pos", "line"))
    keyed = (lines.select("id", "version", "pos", F.btrim("line", F.lit(BLANKS)).alias("bare"))
             .where(F.char_length("bare") >= min_chars)
             .select("id", "version", "pos", line_key(F.col("bare")).alias("key"))
             .select("id", "version", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("line"), "key").alias("h2"),
                     F.pmod(F.xxhash64("id"), F.lit(salts)).cast("byte").alias("salt")))
    ranged = keyed.repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("id").desc_nulls_last(), "pos")
    known = F.row_number().over(order)
    streamed = written(ranged.withColumn("_n", known).withColumn("_before", F.lag("id").over(order))
                       .select("id", "version", "pos", "h1", "h2",
                               ((F.col("_n") == 1) | ~F.col("id").eqNullSafe(F.col("_before"))).alias("first")), "lines")
    # a table of its own, so that its join with a very common line's rows can be split
    common = written(streamed.groupBy("h1", "h2")
                     .agg(F.count_if("first").alias("n_docs"), F.max("id").alias("keeper"))
                     .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "common")
    lost = (streamed.join(common, ["h1", "h2"])
            .where(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
            .select("id", "version", "pos").groupBy("id", "version")
            .agg(F.sort_array(F.collect_set("pos")).alias("dropped")))
    return lost.select("id", "version", F.size("dropped").alias("n_dropped"), "dropped")


def kept_ranges(dropped: Column, n_lines: Column) -> Column:
    """Run-length form of the keep bitmap: (start, length) of each range of kept lines."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    starts = F.slice(edges, 1, F.size(edges) - 1)
    ends = F.slice(edges, 2, F.size(edges) - 1)
    runs = F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (run-length coded keep bitmap) instead of its text."""
    return _decided(docs, id, text, **rule).drop("_lines", text)


def _decided(docs: DataFrame, id: str, text: str, **rule) -> DataFrame:
    lost = keep_runs(docs, id, text, **rule).select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), "n_dropped", "dropped")
    own = docs.withColumn("_mark", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    joined = own.join(lost, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_version")), "left")
    lines = joined.withColumn("_lines", lines_of(F.col(text))).withColumn("n_lines", F.size("_lines"))
    kept = F.when(F.col("dropped").isNull(), F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length"))))
    kept = kept.otherwise(kept_ranges(F.col("dropped"), F.col("n_lines")))
    return (lines.withColumn("kept", kept).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)))
            .drop("_mark", "_id", "_version", "dropped"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``docs`` with the kept lines as its text, plus ``n_lines`` and ``n_dropped``.

    Rows that lose nothing keep their text as it is (null stays null).  Columns
    named ``n_lines``, ``n_dropped`` or ``kept`` in ``docs`` are replaced.
    """
    clash = [c for c in docs.columns if c in ("n_lines", "n_dropped", "kept", "dropped")]
    decided = _decided(docs.drop(*clash), id, text, **rule)
    parts = F.flatten(F.transform("kept", lambda r: F.slice("_lines", r["start"] + 1, r["length"])))
    joined = F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join(parts, "\n"))
    return decided.withColumn(text, joined).drop("_lines", "kept")


#: DuckDB twin of the query.
ORACLE = """
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from cut),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from each),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where keeper > doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or keeper <= doc_id), '')) as kept_sha256
from keyed left join common using (key) group by doc_id
"""
