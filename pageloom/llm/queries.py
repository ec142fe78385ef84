"""One query per operator over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (bpe, chat, decontam, html, language, lines, packing, prefixes, quality, search, sharding, simhash,
                          toxicity)
from pageloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_chat", chat.ORACLE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.rotate(table(spark, folder, "conversations"))
    ranges = F.transform("mask", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return views.select("conv_id", "perspective", "part", "n_turns", F.char_length("text").cast("long").alias("n_chars"),
                        masked.alias("n_masked"), F.array_join(ranges, ",").alias("mask"),
                        F.sha2("text", 256).alias("text_sha256"))


@query("op2_line_dedup", lines.ORACLE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                       F.col("n_dropped").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_decontaminate", decontam.ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.fold(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").where(~held_out)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.learn(docs, labels)
    judged = toxicity.score(docs, chain, spans=False)
    return judged.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = language.fold(F.col("doc_id"), 3) == 1
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_html")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    texts = html.extract(pages, html.learn(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality.judge(table(spark, folder, "documents"), trusted)


@query("op11_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end=2)


@query("op12_trie", prefixes.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, folder, "conversations"))


@query("op13_search", search.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
