import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from pageloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(3)
    words = ["Straße", "don't", "we'll", "naïve", "  ", "\n\n", "x" * 40, "12345", "…", "日本語", "🙂🙂", "the", "'", "\t ", "a b", "<|endoftext|>"]
    long = " ".join(rng.choices(words, k=4000))
    return [None, "", " ", "Hello world", "it's", "x" * 3000, " " * 5000 + "end", long, long[::-1], "ab" * 2000, "é" * 900,
            "\x00\x01", "tail   "] + ["".join(rng.choices("ab '\n1ß", k=600)) for _ in range(6)]


def test_as_the_library_and_back(spark):
    other = library()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts())] + [(3, "Hello world", 1, "c")],
                                 "doc_id long, text string, ids int, part string")
    for size, overlap in ((1 << 16, 1 << 10), (256, 64), (64, 32)):
        coded = bpe.encode(docs, RANKS, PATTERN, chunk_chars=size, overlap=overlap, decoded="part")
        rows = coded.withColumn("back", bpe.decode(spark, "ids", RANKS)).collect()
        assert len(rows) == len(texts()) + 1
        for r in rows:
            assert list(r.ids) == other.encode_ordinary(r.text or ""), (size, r.doc_id)
            assert bytes(r.back) == bytes(r.part) == (r.text or "").encode()
    assert bpe.encode(docs.where(F.lit(False)), RANKS, PATTERN).count() == 0


def test_long_pieces_and_forgetting():
    other, own = library(), bpe.Encoder(bpe.load_ranks(RANKS), PATTERN)
    rng = random.Random(5)
    for n in (501, 700, 2500):
        piece = "".join(rng.choices("abcdeé", k=n))
        assert list(own.merge(piece.encode())) == other.encode_ordinary(piece)
    own.memo = {str(i): (i,) for i in range(bpe.MEMO + 1)}
    assert own.ids("some new words") == other.encode_ordinary("some new words")
