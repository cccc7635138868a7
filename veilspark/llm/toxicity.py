"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, owners, runs, slices, word_hashes

BITS = 20
#: Bytes (training: characters) of texts that are worked on at once.
SLICE = 1_000_000
#: Rows of each class in the training sample, in expectation.
POSITIVES, NEGATIVES = 4000, 6000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.6, 1.0, 6.0, 0.0


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed feature) of every word, pair of neighbours and pair around one word."""
    h, counts = word_hashes(texts)
    owner = owners(counts)
    shift = np.uint64(64 - bits)
    of, at = [owner], [mix(h) >> shift]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xC2B2AE3D27D4EB4F))):
            same = owner[:-gap] == owner[gap:]
            of.append(owner[gap:][same])
            at.append(mix(h[:-gap][same] * salt + h[gap:][same]) >> shift)
    return np.concatenate(of), np.concatenate(at).astype(np.int64)


@dataclass
class Model:
    """Non-zero weights by feature, sorted, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal with per-coordinate rates over rows of distinct features, in the order given; feature 1 << bits is the intercept."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        penalty = np.where(at == size, 0.0, l1)  # the intercept is not shrunk
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[at])) / alpha + np.where(at == size, 0.0, l2)))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]), bits)


def _featured(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [x or "" for x in frame["text"]]
            for lo, hi in runs(texts, SLICE):
                of, at = features(texts[lo:hi], bits)
                both = np.unique(of << bits | at)
                parts = np.split((both & ((1 << bits) - 1)).astype("<u4"), np.searchsorted(both >> bits, np.arange(1, hi - lo)))
                parts = [np.append(x, np.uint32(1 << bits)) for x in parts]  # the intercept
                yield pd.DataFrame({"chance": frame["chance"].iloc[lo:hi], "label": frame["label"].iloc[lo:hi], "at": [x.tobytes() for x in parts]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", column: str = "text", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Learn `label` (0 or 1) from a bounded sample of the labelled documents.

    A hash of the key chooses `positives` and `negatives` rows in expectation (all, where
    there are fewer); the intercept is then moved to the classes' true shares. Rows with a
    null label or text teach nothing; without both classes the model gives 0 everywhere.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    share = {1: min(1.0, positives / counts[1]), 0: min(1.0, negatives / counts[0])}
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("labels")), F.lit(1_000_003)) / 1_000_003
    sample = known.withColumn("chance", chance).where(F.col("chance") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(key, F.col(column).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(sample), key)
    got = rows.select("chance", "label", "text").mapInPandas(_featured(BITS), "chance double, label int, at binary").toArrow().combine_chunks()
    y, chances = got.column("label").to_numpy(), got.column("chance").to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    at = [np.frombuffer(x.as_buffer(), "<u4") for x in got.column("at")]  # views, no copies
    # by the draw within the class, so that both classes are spread over the whole order
    order = sorted(range(len(y)), key=lambda i: (chances[i] / share[int(y[i])], y[i], len(at[i])))
    model = ftrl([at[i] for i in order], y[order])
    model.bias += float(np.log(share[0] / share[1]))
    return model


def scores(texts: list[str], model: Model, weight: np.ndarray) -> np.ndarray:
    """Score of each text; a feature counts once in a text."""
    of, at = features(texts, model.bits)
    heavy = weight[at] != 0
    both = np.unique(of[heavy] << model.bits | at[heavy])
    total = np.bincount(both >> model.bits, weight[both & ((1 << model.bits) - 1)], len(texts)) + model.bias
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-total))


def _scored(shared, key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weight = model.dense()
        for batch in batches:
            for lo, hi, texts in slices(batch, SLICE, column):
                yield pa.RecordBatch.from_pydict({key: batch.column(key).slice(lo, hi - lo), "score": pa.array(scores(texts, model, weight), pa.float64())})

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: likelier toxic) of every whole text.

    A feature counts once in a text. Null and empty texts get the intercept's score. Rows
    are independent; repeated rows come out repeated, an empty table gives an empty
    result, other columns are not read. The weights are a broadcast of at most 2 ** BITS
    entries; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, column).mapInArrow(_scored(shared, key, column), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def _below(shared, column: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weight = model.dense()
        for batch in batches:
            for lo, hi, texts in slices(batch, SLICE, column):
                yield batch.slice(lo, hi - lo).filter(pa.array(scores(texts, model, weight) < threshold))

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float, column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_below(shared, column, threshold), docs.schema)
