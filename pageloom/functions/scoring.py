"""User scorers, table functions, grouped aggregates and the score cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from pageloom.core.canon import canonical
from pageloom.functions.text import chunk_pattern
from pageloom.sources.archives import member_rows

# Result columns each kind of scorer must return beside its keys.
CONTRACTS = {
    "detection": "label string, confidence double, x double, y double, w double, h double",
    "ocr": "text string, confidence double, orientation string",
    "translation": "translated_text string",
    "inpainting": "clean_path string, changed_pixels bigint",
    "rendering": "rendered_path string, overflow boolean",
}


def apply_scorer(df: DataFrame, kind: str, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keys: str) -> DataFrame:
    """Run a user's scorer over batches; ``factory`` builds it once per task."""
    names = [c.strip().split(" ")[0] for c in f"{keys}, {CONTRACTS[kind]}".split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = None
        for batch in batches:
            score = score or factory()
            out = score(batch)
            missing = set(names) - set(out.columns)
            if missing:
                raise ValueError(f"{kind} scorer left out {sorted(missing)}")
            yield out[names]
    return df.mapInPandas(run, f"{keys}, {CONTRACTS[kind]}")


def passthrough(df: DataFrame, text: str) -> DataFrame:
    """The offline translation: the source text itself, flagged for review."""
    return df.withColumn("translated_text", F.col(text)).withColumn("translation_fallback", F.lit(True))


@udtf(returnType="chunk: int, chunk_text: string")
class TextChunks:
    def eval(self, text: str, limit: int):
        for number, piece in enumerate(regex.findall(chunk_pattern(limit).replace(r"\z", r"\Z"), text or "")):
            yield number, piece


@udtf(returnType="archive: string, member: string, bytes: bigint, is_dir: boolean, is_link: boolean, encrypted: boolean")
class ArchiveMembers:
    def eval(self, archive: str, content: bytes):
        yield from member_rows(archive, content)


@udtf(returnType="x: int, y: int, w: int, h: int")
class PageTiles:
    """Overlapping tiles of a page: a tenth of the side shared, last ones moved inside."""

    def eval(self, width: int, height: int, side: int):
        stride = max(1, side - side // 10)
        spots = lambda page: [min(k * stride, max(0, page - side)) for k in range(max(1, -(-max(0, page - side) // stride) + 1))]
        for y in spots(height):
            for x in spots(width):
                yield x, y, min(side, width - x), min(side, height - y)


def register_table_functions(spark: SparkSession) -> None:
    for name, fn in (("text_chunks", TextChunks), ("archive_members", ArchiveMembers), ("page_tiles", PageTiles)):
        spark.udtf.register(name, fn)


@F.pandas_udf(T.DoubleType())
def p95_index(values: pd.Series) -> float:
    """Value at index ceil(.95 n) - 1; for groups known to be small (see ``ranking.value_ranks``)."""
    return float(values.sort_values().iloc[-(-len(values) * 95 // 100) - 1])


@F.pandas_udf(T.LongType())
def runs_area(x0: pd.Series, x1: pd.Series) -> int:
    """Pixels under the union of one scan line's runs; the native form is ``intervals.merge_runs``."""
    total, reach = 0, None
    for a, b in sorted(zip(x0, x1)):
        start = a if reach is None else max(a, reach)
        total += max(0, b - start)
        reach = b if reach is None else max(reach, b)
    return int(total)


def cache_key(df: DataFrame, config: str, inputs: Sequence[str]) -> DataFrame:
    """Key of configuration and inputs; nulls and empty texts differ, as do values in other columns."""
    return df.withColumn("cache_key", F.sha2(F.concat(F.lit(config), F.lit("\x1f"), canonical(inputs)), 256))


def cached_score(df: DataFrame, cache: DataFrame, config: str, inputs: Sequence[str], score: Callable[[DataFrame], DataFrame],
                 result: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows answered from the cache, freshly scored rows, corrupt cache entries).

    A key with several different saved results, or a null one, is corrupt: it is
    never used, and its rows are scored anew.  Every row is in one of the first two.
    """
    keyed = cache_key(df, config, inputs)
    saved = cache.groupBy("cache_key").agg(
        F.min(result).alias(result), F.max(result).alias("_high"), F.count_if(F.col(result).isNull()).alias("_null"))
    is_sound = (F.col("_null") == 0) & (F.col(result) == F.col("_high"))
    sound = saved.where(is_sound).drop("_high", "_null")
    corrupt = saved.where(~F.coalesce(is_sound, F.lit(False))).select("cache_key")
    hits = keyed.join(sound, "cache_key")
    misses = keyed.join(sound.select("cache_key"), "cache_key", "left_anti")
    return hits, score(misses), corrupt
