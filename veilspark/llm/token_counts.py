"""Token counts through a cache that is keyed by digests.

A stored count belongs to a pair (digest of the normalised content, digest of the tokenizer
file). Documents are joined to the cache; each distinct missing content is encoded once
and its count appended.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import Pieces
from .shared import NARROW, shared_dir, written
from .words import runs, texts_of

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """The content that is counted. Only null changes, to the empty string: any other rewriting would change counts."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: The pre-token pattern of the ByteLevel pre-tokenizer (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _ByPiece:
    """Counts of a tokenizer that encodes each pre-token by itself; the library counts a distinct pre-token once."""

    def __init__(self, tokenizer, added: list[str]):
        self.tokenizer, self.added, self.pieces, self.known = tokenizer, added, Pieces(BYTE_LEVEL), np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if (stay := self.pieces.forget()) is not None:
            self.known = self.known[stay]
        special = [i for i, x in enumerate(texts) if any(a in x for a in self.added)]
        codes, counts, fresh = self.pieces.number(texts)
        if fresh:
            self.known = np.concatenate([self.known, self.whole([x.decode() for x in fresh])])
        ends = np.concatenate([[0], np.cumsum(self.known[codes])])[np.concatenate([[0], np.cumsum(counts)])]
        out = np.diff(ends).tolist()
        for i, n in zip(special, self.whole([texts[i] for i in special]), strict=True):
            out[i] = n
        return out


def _by_piece(spec: dict) -> bool:
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and model["type"] == "BPE" and not model.get("dropout")


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    counter = _ByPiece(tokenizer, [x.content for x in tokenizer.get_added_tokens_decoder().values()])
    return counter if _by_piece(json.loads(tokenizer.to_str())) else counter.whole


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _load(path)
        seen: set[str] = set()  # repeated rows meet in one task
        for batch in batches:
            fresh = []
            for x in batch.column("content").to_pylist():
                fresh.append(x not in seen)
                seen.add(x)
            batch = batch.filter(pa.array(fresh))
            texts = texts_of(batch)
            for lo, hi in runs(texts, 1_000_000):
                yield pa.RecordBatch.from_pydict({"content": batch.column("content").slice(lo, hi - lo), "n_tokens": pa.array(count(texts[lo:hi]), pa.int64())})

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a cache that is not there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens of every whole text.

    `path` is a tokenizer file (.json or .model) that the driver and all workers have;
    `cache` a folder that all share (default: token_counts in the shared folder). Keys,
    digests and sizes are written once; digests and the hash of one row of each travel to
    find the distinct misses. The rows to be encoded are picked where they are read, by a
    broadcast of the misses or, where these are many, of the digests that are stored
    already or stand in several rows; only if both are more than NARROW do texts move, once,
    to meet their digests. A digest shared by many rows meets its count in a join whose
    large partitions Spark may split. A cache that already holds a digest twice (two runs
    at once) is reduced to one row for each. Null text counts as empty; repeated rows and
    null keys keep a row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token_counts"
    tokenizer = tokenizer_digest(path)
    text = normalised(F.col(column))
    rows = docs.select(F.col(key).alias("key"), text.alias("text")).withColumns({"content": F.sha2(F.col("text"), 256), "pick": F.xxhash64("key")})
    narrow = written(rows.select("key", "content", "pick", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows")
    stored = lambda: read_cache(spark, cache).where(F.col("tokenizer") == tokenizer)
    digests = narrow.groupBy("content").agg(F.min("pick").alias("pick"), F.count("*").alias("n"))
    digests = written(digests.join(stored().select("content", F.lit(True).alias("known")).distinct(), "content", "left"), "token-digests")
    missing, others = digests.where("known is null").select("content", "pick"), digests.where("known or n > 1")
    if missing.count() <= NARROW:
        picked = rows.join(F.broadcast(missing), ["content", "pick"], "left_semi")
    elif others.count() <= NARROW:
        met = rows.join(F.broadcast(others.select("content", F.when(F.col("known").isNull(), F.col("pick")).alias("one"), F.lit(True).alias("other"))), "content", "left")
        picked = met.where(F.col("other").isNull() | (F.col("pick") == F.col("one")))
    else:
        picked = rows.join(missing.hint("shuffle_hash"), ["content", "pick"], "left_semi")
    once = picked.select("content", "text").mapInArrow(_counts(path), "content string, n_tokens long")
    once.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return narrow.join(counts, "content").select(F.col("key").alias(key), "n_bytes", "n_tokens")
