"""Quality by hashed n-gram importance, with a few base rules.

Two multinomials over hashed uni- and bigrams are counted: the trusted target's
(documents labelled good) and the raw corpus's.  A document's score is its
log-likelihood ratio per n-gram; it is kept if no base rule fails and the
score reaches a threshold, which is a fixed quantile of the trusted documents'
scores, read from an exact histogram.  Everything is a column expression.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.core.shared import written

WORD_GAP = "[ \\t\\n\\x0b\\f\\r]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def _removed(text: Column, characters: str) -> Column:
    """How often the characters occur."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeats are found without leaving the row: the hashes of its 3-word windows
    are sorted with their places, and neighbours in that order are compared.
    """
    content = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = docs.withColumn("_words", words_of(docs[text])).withColumn("_lines", lines).select(
        "*", F.size("_words").cast("long").alias("n_words"),
        (F.char_length(content) - _removed(content, BLANKS)).cast("long").alias("word_chars"),
        _removed(content, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")).drop("_lines")
    windows = F.when(F.size("_words") < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.sort_array(F.transform(
            F.slice("_words", 1, F.size("_words") - 2),
            lambda w, i: F.struct(F.xxhash64(w, F.element_at("_words", i + 2), F.element_at("_words", i + 3)).alias("h"),
                                  i.alias("p")))))
    counted = counted.withColumn("_sorted", windows)
    repeated = F.filter(
        F.col("_sorted"),
        lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]))
    counted = counted.withColumn("_places", F.sort_array(F.transform(repeated, lambda x: x["p"]))).drop("_sorted")
    covered = F.aggregate(
        "_places", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return counted.withColumn("n_repeat_words", covered).drop("_places")


def _grams(words: Column, buckets: int) -> Column:
    """Hash buckets of all words and all adjacent pairs."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pair = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(w, F.element_at(words, i + 2)), F.lit(buckets)).cast("int"))
    return F.concat(single, pair)


def log_ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text",
               buckets: int = 10_000, max_trusted: int = 100_000) -> list[float]:
    """Per bucket: log P(bucket | trusted) - log P(bucket | all), add-one smoothed.

    ``trusted`` lists the ids of trusted documents; the target is fitted on at
    most ``max_trusted`` of them (those with the smallest hashes, which bounds
    what is broadcast), the raw counts cover all documents.  The result has
    ``buckets`` entries, whatever the corpus.
    """
    known = (trusted.select(F.col(id).alias("_id")).where("_id is not null").distinct()
             .orderBy(F.xxhash64("_id"), "_id").limit(max_trusted).withColumn("_good", F.lit(1)))
    marked = docs.select(F.col(id).alias("_id"), docs[text].alias("_text")).join(F.broadcast(known), "_id", "left")
    grams = (marked.select("_good", words_of(F.col("_text")).alias("w"))
             .select("_good", F.explode(_grams(F.col("w"), buckets)).alias("bucket")))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("_good").alias("good")).collect()
    every, good = [1] * buckets, [1] * buckets
    for r in rows:
        every[r.bucket] += r.n
        good[r.bucket] += r.good
    all_sum, good_sum = sum(every), sum(good)
    return [math.log(g / good_sum) - math.log(n / all_sum) for g, n in zip(good, every)]


def scored(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with base counts and ``llr``, the mean log ratio of its n-grams (0 without words)."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    counted = base_counts(docs, text).withColumn("_grams", _grams(F.col("_words"), len(ratios)))
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return counted.withColumn("llr", F.coalesce(total / F.nullif(F.size("_grams"), F.lit(0)), F.lit(0.0))).drop("_grams", "_words")


def threshold(scores: DataFrame, trusted: DataFrame, share: float, id: str = "doc_id", step: float = 0.001) -> float:
    """The largest multiple of ``step`` that at most ``share`` of the trusted scores lie below.

    The histogram has as many rows as there are distinct steps among scores,
    which the counts' logarithms bound; it does not depend on row order.
    """
    good = scores.join(trusted.select(id).where(F.col(id).isNotNull()).distinct(), id, "left_semi")
    bins = good.groupBy(F.floor(F.col("llr") / step).cast("long").alias("bin")).count().orderBy("bin").collect()
    allowed, below = share * sum(r["count"] for r in bins), 0
    for r in bins:
        below += r["count"]
        if below > allowed:
            return r.bin * step
    return -math.inf


def judge(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = 10_000,
          lost_share: float = 0.001, max_trusted: int = 100_000) -> DataFrame:
    """One row per document: id, base counts, ``llr``, ``base_failed`` and ``kept``.

    A document fails the base with fewer than 50 words, or if over half of them
    stand in 3-word windows that occur twice or more in it.  Otherwise it is
    kept if its score is not below the threshold, under which ``lost_share`` of
    the trusted documents that pass the base lie.  Null ids are never trusted;
    null and empty texts have no words.  Repeated rows count and are judged as
    often as they come; without trusted documents every score is compared with
    no threshold.  Other columns are not read.
    """
    own = docs.select(docs[id].alias(id), docs[text].alias("_content"))
    ratios = log_ratios(own, trusted, id, "_content", buckets, max_trusted)
    marks = scored(own, ratios, "_content").drop("_content").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    marks = written(marks, "quality")
    least = threshold(marks.where("not base_failed"), trusted, lost_share, id)
    return marks.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))
