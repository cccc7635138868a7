"""A training-data pipeline over `documents`, stage by stage.

Each stage works on all that its predecessor kept. Language identification drops
documents without a language; the toxicity model, fitted on the labelled rows, drops what
it predicts as toxic; of near-duplicate documents the smallest doc_id stays; the mix
repeats or drops documents until each source meets its target; the last stage encodes
what is left. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, langid, mixing, near_dup, queries, toxicity
from veilspark.llm.shared import removed, settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the labelled ones teach; null texts and texts without letters go."""
    return langid.drop_undetermined(docs, queries.language_model(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, fitted on the labelled ones, does not predict as toxic; all where there are no labels."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, docs, sf_dir), queries.TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest key; documents without words or keys stay."""
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, so doc_id may repeat; documents that it does not take go."""
    size, quality = queries.mix_columns()
    return mixing.repeated(docs, size, quality)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


#: (name, function); each function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: Language models, alignment and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's own tables go when its documents are written, and those of the stage before with them; the last written stage stays, as the result reads it."""
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name}")
        if former:
            removed(spark, former)
        former = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
