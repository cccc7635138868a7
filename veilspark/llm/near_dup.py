"""Near-duplicate documents by Order MinHash and banded alignment.

A document's k-mers of words carry their occurrence number. Each of several hash functions
picks the few least of them, and their hashes in text order make one value of the sketch:
documents share a value with a probability that grows with their edit similarity.
Documents that share a value are candidates; word-level edit distance inside a diagonal
band decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, extended
from .shared import settled, small, written
from .words import mix, owners, slices, word_hashes

#: Words of a k-mer; values of a sketch; k-mers of a value (of spread edits at the least similarity, 0.95 of the pairs and more share a value); edit similarity of a link.
K, VALUES, PICK, SIMILARITY = 3, 32, 2, 0.8
#: Members of a bucket whose pairs are rows; larger buckets meet in blocks, and their texts get finer values, FINER of rare words and FINER of three k-mers.
WHOLE, FINER = 64, 16
#: Nodes (32 bytes each, some 100 in memory) up to which a table of them is broadcast.
BROADCAST_NODES = 500_000
#: Bytes of texts, words of stored texts that are worked on at once.
SLICE_BYTES, SLICE_WORDS = 1_000_000, 200_000
#: Slots of a text's bag of words; texts whose word pairs a task holds.
BAG, HELD = 256, 2000
#: Words of a block of a large bucket, each text counting BAG more; a task holds two blocks.
BLOCK_WORDS = 500_000
#: Slots of the counts that tell rare words from frequent ones.
RARITY_SLOTS = 1 << 20


def kmers(h: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each occurrence-labelled k-mer in text order, k-mers of each text).

    A text of fewer than k words is one k-mer; a text without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = owners(n)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    key = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = at + i < ends[owner]
        key = np.where(inside, mix(key * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + i, len(h) - 1)]), key) if len(h) else key
    mine = mix(key + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mine, kind="stable")
    new = np.concatenate([[True], mine[order][1:] != mine[order][:-1]]) if len(mine) else np.empty(0, bool)
    first = np.flatnonzero(new)
    occurrence = np.empty(len(mine), np.uint64)
    occurrence[order] = np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))
    return mix(key + occurrence * np.uint64(0xA0761D6478BD642F)), n


def sketches(key: np.ndarray, n: np.ndarray, values: int = VALUES, pick: int = PICK) -> np.ndarray:
    """Sketch values of each text with k-mers: text x value."""
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    owner = owners(n[full])
    out = np.zeros((len(n), values), np.int64)
    if not len(key):
        return out
    top = np.uint64(2**64 - 1)
    for t in range(values):
        x = mix(key ^ mix(np.array([t + 1], np.uint64)))
        places, hashes = [], []
        for _ in range(pick):
            least = np.minimum.reduceat(x, starts)
            at = np.full(len(starts), -1)
            where = np.flatnonzero(x == least[owner])
            at[owner[where]] = where
            spent = least == top  # fewer k-mers than picks
            places.append(np.where(spent, places[0] if places else at, at))
            hashes.append(np.where(spent, hashes[0] if hashes else least, least))
            x[where] = top
        order = np.argsort(np.stack(places, 1), 1, kind="stable")
        picked = np.take_along_axis(np.stack(hashes, 1), order, 1)
        value = np.full(len(starts), t, np.uint64)
        for i in range(pick):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + picked[:, i])
        out[full, t] = value.view(np.int64)
    return out


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance inside the band of `most` diagonals either side; most + 1 where it is greater.

    The band of one column is a bit vector that slides along the diagonal: its lowest bit
    stands for the row `most` above the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    n, m = len(a), len(b)
    width = 2 * most + 1
    mask = (1 << width) - 1
    # rows: a; columns: b. Bit i of column j: row j - most + i (from 1).
    rows: dict[int, int] = {}
    for i, w in enumerate(a, most):  # places shifted by `most`, so the band never starts below bit 0
        rows[w] = rows.get(w, 0) | 1 << i
    up, down = (mask << most) & mask, 0  # vertical differences of column 0: rows from 1 on rise, those above the matrix are level
    score = most  # at the band's lowest row
    end = n - m  # row of the last column's end relative to its diagonal
    for j in range(m):
        match = (rows.get(b[j], 0) >> j) & mask
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        rise = down | (mask & ~(zero | up))
        fall = zero & up
        score += not zero >> (width - 1) & 1
        if score - 2 * most > most:
            return most + 1
        slid = zero >> 1
        up = fall | (mask & ~(slid | rise))
        down = slid & rise
    # from the band's lowest row back up to the matrix's corner
    for i in range(width - 1, most + end, -1):
        score -= (up >> (i - 1)) & 1
        score += (down >> (i - 1)) & 1
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / words of the longer text reaches `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance(a.tolist(), b.tolist(), most) <= most


def _sketched(k: int, values: int, pick: int):
    """The row's key and text digest with its words: their digest (the node), 32-bit hashes and sketch; null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, texts in slices(batch, SLICE_BYTES):
                    h, counts = word_hashes(texts)
                    x, n = kmers(h, counts, k)
                    short = h.astype("<u4")
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    parts = list(zip(bounds[:-1], bounds[1:], strict=True))
                    values_ = sketches(x, n, values, pick)
                    yield pa.RecordBatch.from_pydict({
                        "doc": batch.column("doc").slice(lo, hi - lo), "content": batch.column("content").slice(lo, hi - lo),
                        "node": pa.array([hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in parts], pa.binary()), "n_words": pa.array(counts.astype(np.int32)),
                        "words": pa.array([short[a:b].tobytes() for a, b in parts], pa.binary()),
                        "sketch": pa.ListArray.from_arrays(np.arange(0, values_.size + 1, values, dtype=np.int32), pa.array(values_.ravel())),
                    })

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_WORDS words, one text at least: a task's memory does not depend on the batch."""
    for batch in batches:
        lo, size = 0, 0
        for i, x in enumerate(batch.column("words")):
            size += len(x.as_buffer()) // 4
            if size >= SLICE_WORDS or i == batch.num_rows - 1:
                yield batch.slice(lo, i + 1 - lo)
                lo, size = i + 1, 0


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) as `word_hashes` gives them, from stored 32-bit hashes."""
    parts = [np.frombuffer(x, "<u4") for x in batch.column("words").to_pylist()]
    return np.concatenate(parts).astype(np.uint64) if parts else np.empty(0, np.uint64), np.array([len(x) for x in parts], np.int64)


class _Texts:
    """Decides pairs of texts and holds the words and word pairs of up to HELD of them. Texts that share fewer of these than similar ones must are not aligned."""

    def __init__(self, least: float):
        self.least = least
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _of(self, id: int, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if id not in self.known:
            if len(self.known) >= HELD:
                self.known.clear()
            w = np.frombuffer(words, "<u4")
            with np.errstate(over="ignore"):
                self.known[id] = w, *[np.sort(kmers(w.astype(np.uint64), np.array([len(w)]), k)[0]) for k in (1, 2)]
        return self.known[id]

    def near(self, i: int, j: int, x: bytes, y: bytes) -> bool:
        a, b = self._of(i, x), self._of(j, y)
        longer = max(len(a[0]), len(b[0]))
        most = int((1 - self.least) * longer + 1e-9)
        if any(longer - (k - 1) - k * most > len(np.intersect1d(a[k], b[k], True)) for k in (1, 2)):
            return False
        return similar(a[0], b[0], self.least)


def _aligned(least: float):
    """Pairs of similar texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = _Texts(least)
        for f in frames:
            good = [texts.near(*pair) for pair in zip(f["a"], f["b"], f["wa"], f["wb"], strict=True)]
            yield f.loc[good, ["a", "b"]]

    return run


def _texts_of_words():
    """How many texts hold each slot of occurrence-labelled words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in _slices(batches):
                slot, n = np.unique(kmers(*_words_of(batch), 1)[0] % np.uint64(RARITY_SLOTS), return_counts=True)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot.astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return run


def finer(h: np.ndarray, counts: np.ndarray, often: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, the text of each): FINER least words of each text that no more than WHOLE texts hold, and FINER values of three k-mers."""
    key, n = kmers(h, counts, 1)
    rare = often[(key % np.uint64(RARITY_SLOTS)).astype(np.int64)] <= WHOLE
    few = np.bincount(owners(n)[rare], minlength=len(n))
    words, longer = sketches(key[rare], few, FINER, 1) ^ np.int64(1), sketches(*kmers(h, counts, k), FINER, 3)
    texts = np.arange(len(counts))
    return np.concatenate([words[few > 0].ravel(), longer.ravel()]), np.concatenate([np.repeat(texts[few > 0], FINER), np.repeat(texts, FINER)])


def _finer(often, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in _slices(batches):
                h, counts = _words_of(batch)
                values, text = finer(h, counts, often.value, k)
                yield pa.RecordBatch.from_pydict({"value": pa.array(values), "id": batch.column("id").take(pa.array(text)), "n_words": pa.array(counts[text].astype(np.int32))})

    return run


def _classed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that are still of several classes, with their class and the bucket's size."""
    classed = buckets.join(small(found, BROADCAST_NODES).select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))
    still = classed.groupBy("value").agg(F.count("*").alias("members"), (F.min("class") != F.max("class")).alias("open")).where("open").drop("open")
    return classed.join(still, "value")


def _near(least: float) -> Column:
    return (F.least("n_words", "other_words") >= least * F.greatest("n_words", "other_words")) & (F.col("class") != F.col("other_class"))


def _pairs(met: DataFrame, least: float) -> DataFrame:
    return met.where(_near(least)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _others(buckets: DataFrame) -> DataFrame:
    return buckets.withColumnsRenamed({"id": "other", "n_words": "other_words", "class": "other_class", "left": "other_left"})


def _with_centres(buckets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of each member of a classed bucket and the bucket's centre."""
    centres = buckets.groupBy("value").agg(F.min(F.struct("id", "n_words", "class")).alias("c"))
    centres = centres.select("value", F.col("c.id").alias("other"), F.col("c.n_words").alias("other_words"), F.col("c.class").alias("other_class"))
    return _pairs(buckets.join(centres, "value"), least)


def _first_centres(buckets: DataFrame, least: float) -> DataFrame:
    """Pairs of each node and the least of the centres of its buckets that is near it in length: one alignment for each node."""
    met = buckets.withColumns({"class": F.col("id"), "other": F.col("centre.id"), "other_words": F.col("centre.n_words"), "other_class": F.col("centre.id")})
    return _pairs(met.where(_near(least)).groupBy("id", "n_words", "class").agg(F.min(F.struct("other", "other_words", "other_class")).alias("c")).select("id", "n_words", "class", "c.*"), least)


def _all_pairs(buckets: DataFrame, least: float) -> DataFrame:
    """All pairs of each small classed bucket."""
    met = buckets.join(_others(buckets).drop("members"), "value").where(F.col("id") < F.col("other"))
    return _pairs(met, least)


def _some(words: DataFrame, ids: DataFrame) -> DataFrame:
    """id and words of the given texts; beyond BROADCAST_NODES texts all word hashes are shuffled once."""
    return words.join(small(written(ids, "omh-nodes"), BROADCAST_NODES), "id", "left_semi").dropDuplicates(["id"])


def _finer_buckets(words: DataFrame, hot: DataFrame, k: int) -> DataFrame:
    """value, id, n_words: finer values of the hot buckets' texts, those that several texts have."""
    spark = words.sparkSession
    texts = written(_some(words, hot), "omh-hot-words")
    often = np.zeros(RARITY_SLOTS, np.int64)
    total = texts.mapInArrow(_texts_of_words(), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often[total["slot"].to_numpy()] = total["n"].to_numpy()
    values = written(texts.mapInArrow(_finer(spark.sparkContext.broadcast(often), k), "value long, id long, n_words int"), "omh-finer")
    several = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(values.join(several, "value", "left_semi"), "omh-finer-shared")


def _bagged(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Text x slot."""
    slots = owners(counts) * BAG + (h % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(slots, minlength=len(counts) * BAG), 255).astype(np.uint8).reshape(-1, BAG)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a text fall into each of BAG slots, 255 at most."""
    for batch in _slices(batches):
        h, counts = _words_of(batch)
        bags = _bagged(h, counts)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "bag": pa.array([b.tobytes() for b in bags], pa.binary()), "n_words": pa.array(counts.astype(np.int32))})


def _sifted(least: float):
    """Pairs whose bags differ by no more than similar texts' may: an edit changes two slots by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("ba", "bb"))
            longer = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            good = np.abs(x - y).sum(1) <= 2 * np.floor((1 - least) * longer + 1e-9)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good)) for c in ("a", "b")})

    return run


def _verified(words: DataFrame, pairs: DataFrame, done: DataFrame | None, least: float) -> tuple[DataFrame, DataFrame]:
    """The similar ones of the pairs that are not done, and all of these pairs.

    Bags of words, a tenth of the size of words, go first and leave few pairs that are not similar.
    """
    pairs = pairs.distinct()
    pairs = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "omh-pairs")
    ends = lambda p: p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    some = written(_some(words, ends(pairs)), "omh-words")
    bags = small(written(some.mapInArrow(_bags, "id long, bag binary, n_words int"), "omh-bags"), BROADCAST_NODES // 4)
    side = lambda c: bags.select(F.col("id").alias(c), F.col("bag").alias(f"b{c}"), F.col("n_words").alias(f"n{c}"))
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ba", "bb", "na", "nb").mapInArrow(_sifted(least), "a long, b long"), "omh-near")
    some = some.hint("merge")  # a small table would else be broadcast and leave the pairs in the few partitions that they are written in
    both = near.join(some.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(some.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return written(both.select("a", "b", "wa", "wb").mapInPandas(_aligned(least), "a long, b long"), "omh-links"), pairs


def _met(least: float):
    """Links (a, b), a < b, between texts of different classes of two blocks, or inside one block.

    Every pair is decided, by length, bags, shared words and then alignment, but for those
    that links found here have brought into one class. Of the buckets in which two texts meet, a hash chooses the one that decides them.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_words", "id"])
        value, n, id, words, second = f["value"].iloc[0], f["n_words"].to_numpy().astype(np.int64), f["id"].to_numpy(), f["words"].to_numpy(), f["second"].to_numpy()
        of = f["class"].to_numpy().copy()
        names, at = np.unique(np.concatenate(f["values"].to_list()), return_inverse=True)
        within, this = np.zeros((len(f), len(names)), bool), np.searchsorted(names, value)
        within[owners(f["values"].map(len).to_numpy()), at] = True
        h = np.concatenate([np.frombuffer(x, "<u4") for x in words]).astype(np.uint64)
        bags = _bagged(h, n).astype(np.int16)
        with np.errstate(over="ignore"):
            code = np.unique(kmers(h, n, 1)[0], return_inverse=True)[1]
        starts, mine = np.cumsum(n) - n, np.zeros(len(h), bool)
        alone, texts, links = not second.any(), _Texts(least), []
        most = np.floor((1 - least) * n + 1e-9).astype(np.int64)
        shortest = np.searchsorted(n, n - most)  # shorter texts are too short for this one
        for i in range(len(f)):
            j = np.arange(shortest[i], i)
            j = j[(of[j] != of[i]) & (alone | (second[j] != second[i]))]
            both = within[j] & within[i]
            with np.errstate(over="ignore"):
                turn = mix((id[j] ^ id[i]).view(np.uint64)) % both.sum(1).astype(np.uint64)
            j = j[both[:, :this].sum(1) == turn.astype(np.int64)]
            j = j[np.abs(bags[j] - bags[i]).sum(1) <= 2 * most[i]]
            if not len(j):
                continue
            own = code[starts[i] : starts[i] + n[i]]
            mine[own] = True
            first = np.cumsum(n[j]) - n[j]
            shared = np.add.reduceat(mine[code[np.repeat(starts[j] - first, n[j]) + np.arange(n[j].sum())]], first, dtype=np.int64)
            mine[own] = False
            for k in j[shared >= n[i] - most[i]]:
                if of[k] != of[i] and texts.near(id[i], id[k], words[i], words[k]):
                    links.append((min(id[i], id[k]), max(id[i], id[k])))
                    of[of == of[k]] = of[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _links_in_blocks(words: DataFrame, buckets: DataFrame, least: float) -> DataFrame:
    """Links between the members of different classes of large classed buckets, all pairs of them.

    Members are dealt into blocks of about BLOCK_WORDS words by bucket, class of length and
    a hash. Texts of a bucket can only be similar in one class of length or in neighbouring
    ones, so each two blocks of these meet in one task, which holds no others and gives out links
    alone. Pairs are the square of a bucket, as all are decided; rows moved are a block's
    members for each block that they meet.
    """
    step = 0.01 - math.log(least)  # a little wider than the ratio of the lengths of similar texts
    buckets = buckets.select("value", "id", "n_words", "class", F.floor(F.log("n_words") / step).alias("size"))
    sizes = buckets.groupBy("value", "size").agg(F.ceil(F.sum(F.col("n_words") + BAG) / BLOCK_WORDS).alias("n"))
    sizes = written(sizes, "omh-sizes")
    blocks = sizes.select("value", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    other = blocks.select("value", F.col("size").alias("size2"), F.col("block").alias("block2"))
    meet = (F.col("size2") == F.col("size") + 1) | ((F.col("size2") == F.col("size")) & (F.col("block2") >= F.col("block")))
    meetings = written(blocks.join(other, "value").where(meet), "omh-meetings")
    meeting, at = ["value", "size", "block", "size2", "block2"], ["value", "size", "block"]
    members = written(buckets.join(small(sizes), ["value", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n"))).drop("n"), "omh-members")
    first = members.join(small(meetings), at).withColumn("second", F.lit(False))
    apart = meetings.where((F.col("size2") != F.col("size")) | (F.col("block2") != F.col("block")))
    second = members.withColumnsRenamed({"size": "size2", "block": "block2"}).join(small(written(apart, "omh-apart")), ["value", "size2", "block2"]).withColumn("second", F.lit(True))
    columns = [*meeting, "id", "n_words", "class", "second"]
    values = members.groupBy("id").agg(F.collect_set("value").alias("values"))
    some = written(_some(words, values.select("id")).join(values, "id"), "omh-block-words").hint("merge")
    rows = first.select(columns).union(second.select(columns)).join(some, "id")
    return written(rows.groupBy(*meeting).applyInPandas(_met(least), "a long, b long").distinct(), "omh-block-links")


def _numbered(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`firsts` with id, a 64-bit number of the digest that no two digests share; the digests whose number is not simply their hash).

    Digests whose hashes meet (few in 10 ** 10) are hashed again until none do.
    """
    numbered, salt = firsts.withColumn("id", F.xxhash64("node")), 0
    renamed = firsts.select("node", F.lit(0).cast("long").alias("id")).limit(0)
    while True:
        met = written(numbered.groupBy("id").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").drop("n"), "omh-met")
        if met.isEmpty():
            return numbered, renamed
        salt += 1
        again = numbered.join(F.broadcast(met), "id").where(F.col("node") != F.col("first")).select("node", F.xxhash64("node", F.lit(salt)).alias("id"))
        renamed = written(renamed.join(again.select("node"), "node", "left_anti").union(again), "omh-renamed")
        numbered = _with_ids(firsts, renamed)


def _with_ids(rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """Rows with the id of their node."""
    return rows.join(small(renamed.withColumnRenamed("id", "other_id")), "node", "left").withColumn("id", F.coalesce("other_id", F.xxhash64("node"))).drop("other_id")


def _classes(docs: DataFrame, similarity: float, key: str, column: str, k: int, values: int, pick: int) -> DataFrame:
    """doc, content (digest of the text), class_id, n_links, kept: one row for each row of `docs`; see near_duplicates."""
    content = F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))).alias("content")
    rows = docs.select(F.col(key).cast("long").alias("doc"), content, F.col(column).alias("text"))
    rows = written(rows.mapInArrow(_sketched(k, values, pick), "doc long, content binary, node binary, n_words int, words binary, sketch array<long>"), "omh-rows")
    known = rows.where("doc is not null and node is not null")
    firsts = written(known.groupBy("node").agg(F.min("doc").alias("doc"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch")), "omh-firsts")
    firsts, renamed = _numbered(firsts)
    words = _with_ids(known.select("node", "words"), renamed).select("id", "words")
    buckets = firsts.select("id", "n_words", F.explode("sketch").alias("value"))
    centres = buckets.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("id", "n_words")).alias("centre")).where("n > 1").drop("n")
    buckets = written(buckets.join(centres, "value"), "omh-buckets")
    links, done = _verified(words, _first_centres(buckets, similarity), None, similarity)
    found = components(links)
    classed = written(_classed(buckets.drop("centre"), found), "omh-open")
    fresh, more = _verified(words, _with_centres(classed, similarity), done, similarity)
    links, done, found = links.union(fresh), done.union(more), extended(found, fresh)
    classed = written(_classed(classed.drop("class", "members"), found), "omh-open")
    few = F.col("members") <= WHOLE
    pairs = _all_pairs(classed.where(few), similarity)
    hot = written(classed.where(~few).select("id").distinct(), "omh-hot")
    if hot.isEmpty():
        fresh, _ = _verified(words, pairs, done, similarity)
    else:
        met = written(_classed(_finer_buckets(words, hot, k), found), "omh-finer-open")
        fresh, _ = _verified(words, pairs.union(_all_pairs(met.where(few), similarity)), done, similarity)
        large = classed.where(~few).unionByName(met.where(~few))
        fresh = written(fresh.union(_links_in_blocks(words, large, similarity)).distinct(), "omh-fresh")
    links, found = links.union(fresh), extended(found, fresh)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = firsts.select("node", "id", "doc").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = classes.groupBy("component").agg(F.min("doc").alias("class_id"))
    classes = written(classes.join(least, "component").join(degree, "id", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "omh-classes")
    of = F.when(F.col("doc").isNotNull(), F.col("node"))
    out = rows.select("doc", "content", of.alias("node")).join(classes, "node", "left")
    class_id = F.coalesce("class_id", "doc")
    return out.select("doc", "content", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), class_id.eqNullSafe(F.col("doc")).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", column: str = "text", k: int = K, values: int = VALUES, pick: int = PICK) -> DataFrame:
    """key (long), class_id, n_links, kept: one row for each row of `docs`.

    Texts link if the edit similarity of their lower-cased words, 1 - distance / words of
    the longer one, reaches `similarity`. Texts of equal words are one node of the graph;
    class_id is the smallest key of the node's connected class, kept: it is the row's own,
    n_links the links of its node that were verified (classes need no more links than hold
    them together). The texts of one key are apart: each row is decided by its own text,
    so a class always keeps a row. Rows whose text is null or has no words link with
    nothing and are kept, nor do rows without a key (their class is null, and they are
    kept); an empty table gives an empty result; other columns are not read.

    Texts are read once: rows are written with the 32-bit hashes of their words. Copies
    are collapsed by digests before any pairing. Each node first meets one centre, the
    least of its buckets of equal sketch values that is near it in length, which makes
    classes of large groups at one alignment a node; then the centres of all buckets that
    still hold several classes. Then all pairs of different classes in every bucket are
    decided: as rows in a bucket of up to WHOLE members, block against block in a larger one
    (_links_in_blocks). A larger bucket that is still open holds texts that share frequent
    passages: all its texts get finer values besides, least words among
    those that few texts hold and values of three k-mers, whose buckets are decided in the
    same way, so that texts that share no value of the sketch may still meet. No bucket, text or
    candidate is left out: texts that share a value have their link or are in one class. The pairs of a
    large bucket with several classes grow with the square of its classes' texts, in memory that
    does not grow. Word hashes move
    only for texts in candidate pairs (for all texts, once a step, where these are more than
    BROADCAST_NODES).
    """
    out = settled(lambda: _classes(docs, similarity, key, column, k, values, pick), docs.sparkSession, "near-duplicates")
    return out.select(F.col("doc").alias(key), "class_id", "n_links", "kept")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", column: str = "text", k: int = K, values: int = VALUES, pick: int = PICK) -> DataFrame:
    """The rows of `docs`, all columns, without those whose class keeps another row (see near_duplicates).

    Of kept rows that are equal in key and text any one stays. Rows with a null key belong
    to no class and all stay; so do rows of one key whose texts are in different classes.
    A class loses only rows that are not its smallest key's, so none is lost whole. Rows
    stay in place while the keys to drop are no more than BROADCAST_NODES.
    """
    spark = docs.sparkSession
    decided = settled(lambda: _classes(docs, similarity, key, column, k, values, pick), spark, "near-duplicates").where("doc is not null")
    counted = decided.groupBy("doc", "content").agg(F.min("kept").alias("kept"), F.count("*").alias("n"), F.min("class_id").alias("class_id"))
    extra = written(counted.where(~F.col("kept")).select("doc", "content"), "omh-extra")
    repeats = written(counted.where("kept and n > 1").select("doc", "content"), "omh-repeats")
    content = F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc"), content.alias("content"))
    left = rows.join(small(extra, BROADCAST_NODES), ["doc", "content"], "left_anti")
    if repeats.isEmpty():
        return left.select("row.*")
    once = left.join(repeats, ["doc", "content"], "left_semi").groupBy("doc", "content").agg(F.first("row").alias("row"))
    return left.join(repeats, ["doc", "content"], "left_anti").select("row.*").union(once.select("row.*"))
