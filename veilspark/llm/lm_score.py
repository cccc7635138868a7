"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Texts become arrays of word hashes, written once. Every place of a text then gives a row
that is keyed by its word and holds the hashes of the longer n-grams that end there and of
the next word. All n-grams that end in this word or in this word and the next one are
counted by the rows of this key, and so are the contexts of the next word's n-grams: one
shuffle of the rows by key gives all counts that a score needs, of every order, and nothing
travels back to the documents but sums. The word that a place falls back to by itself is
scored with the row of that place, longer n-grams with the row of the place before.

The rows of a share of the words are made, shuffled and summed up at a time, so that disk
holds that share of the rows only. The rows of a frequent word are cut by the word before
and the word after into a square of units; the counts that span several units are added up
by themselves first and sent to each unit that asks for them. A document's own n-grams do
not vouch for it: its counts are taken off before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled, shuffles_removed, written
from .words import RUN_CHARS, mix, owners, slices, word_hashes

ORDER, ALPHA = 3, 0.4

#: The words are dealt into so many shares by hash; the rows of one share are on disk at a time.
SHARES = 4
#: Rows that a task is to hold (by estimate from the corpus's words).
TASK_ROWS = 300_000
#: A word of twice so many places is cut into units of about so many rows: at least, at most.
UNIT_ROWS = 50_000, 750_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngrams(h: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to `order`, the hash of the n words that end at each place, 0 where the text has fewer. h: hashes of the words, text after text; counts: words of each text."""
    at = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = [mix(h + np.uint64(1))]
    for n in range(2, order + 1):
        longer = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            longer[1:] = mix(grams[-1][:-1] * _STEP + h[1:] + np.uint64(n))
        grams.append(np.where(at >= n - 1, longer, np.uint64(0)))
    return grams


def _and(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of both."""
    return mix(x * _STEP + y)


def _sums(group: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """At each row, the sum of the weights (rows, if none) of all rows of its group."""
    codes = pd.factorize(group)[0]
    return np.bincount(codes, weight)[codes].astype(np.int64) if len(codes) else np.empty(0, np.int64)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id, key, text as id, key, n_words, words (a hash each)."""
    for batch in batches:
        for lo, hi, texts in slices(batch, RUN_CHARS):
            h, counts = word_hashes(texts)
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), _longs(h))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts), words], ["id", "key", "n_words", "words"])


def _places(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(document, hashes of the n-grams that end there for each n up to `depth`, hash of the next word or 0 at the end) of each place, some documents at a time."""
    for batch in batches:
        ids, lists = batch.column("id").to_numpy(), batch.column("words")
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        flat = lists.flatten().to_numpy().view(np.uint64)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUN_CHARS // 6, "right")) - 1)
            h, counts = flat[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            if len(h):
                with np.errstate(over="ignore"):
                    grams = ngrams(h, counts, depth)
                after = np.append(grams[0][1:], np.uint64(0))
                after[np.cumsum(counts)[counts > 0] - 1] = 0
                yield ids[lo:hi][owners(counts)], grams, after
            lo = hi


def _share(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(40)) % np.uint64(SHARES)


def _common(least: float):
    """word, times: how often a word stands in some documents, if it is `least` of their words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, _ in _places(batches, 1):
            codes, found = pd.factorize(grams[0])
            times = np.bincount(codes)
            common = times >= least * len(codes)
            yield pa.RecordBatch.from_arrays([_longs(found[common]), pa.array(times[common])], ["word", "times"])

    return run


class _Frequent:
    """The frequent words and the sides of their squares of units."""

    def __init__(self, words: list[tuple[int, int]], unit: int):
        words = sorted((np.int64(w).view(np.uint64), int(np.ceil(np.sqrt(n / unit)))) for w, n in words)
        self.words, self.sides = np.array([w for w, _ in words], np.uint64), np.array([s for _, s in words], np.uint64)

    def side(self, word: np.ndarray) -> np.ndarray:
        """Of each word, 0 of those that are not frequent."""
        if not len(self.words):
            return np.zeros(len(word), np.uint64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.sides[at], np.uint64(0))

    @staticmethod
    def unit(word: np.ndarray, side: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return _and(word, np.uint64(1) + row * side + column)


def _spanning(frequent: _Frequent, depth: int):
    """kind, word, pair, gram, times, docs of the n-grams that units of frequent words have in common: kind 1, the word and the next one; kind n, the n - 1 words up to this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, grams, after in _places(batches, depth - 1):
            among = np.flatnonzero(frequent.side(grams[0]) > 0)
            for kind in range(1, depth + 1):
                gram = after[among] if kind == 1 else grams[kind - 2][among]
                at = among[gram != 0]
                gram = gram[gram != 0]
                with np.errstate(over="ignore"):
                    group = _and(grams[0][at], gram)
                    codes, found = pd.factorize(group)
                    first = np.unique(codes, return_index=True)[1]
                    new = np.unique(_and(group, doc[at].view(np.uint64)), return_index=True)[1]
                out = {"kind": pa.array(np.full(len(found), kind, np.int32)), "word": _longs(grams[0][at][first]), "pair": _longs(grams[1][at][first] if kind > 2 else np.zeros(len(found), np.uint64)), "gram": _longs(gram[first])}
                yield pa.RecordBatch.from_pydict(out | {"times": pa.array(np.bincount(codes)), "docs": pa.array(np.bincount(codes[new]))})

    return run


def _names(depth: int) -> list[str]:
    """Columns of the rows. who: twice the document, and one if the word is frequent; minus the kind in rows of `_spanning`. times: counts of 32 bits, the places and ownM; owns: own2 and own3, ..."""
    return ["unit", "who", "next", "times", *[f"c{n}" for n in range(3, depth + 1)], *[f"owns{n}" for n in range(2, depth + 1, 2)]]


def _two(low: np.ndarray, high: np.ndarray | int) -> np.ndarray:
    """Two counts of a text as one number."""
    return low | high << 32


def _low(x: np.ndarray) -> np.ndarray:
    return x & 0xFFFFFFFF


def _dealt(frequent: _Frequent, depth: int, share: int):
    """Rows of the counts of `_spanning` for each unit that asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            word, pair, gram = (x[c].view(np.uint64) for c in ("word", "pair", "gram"))
            mine = np.flatnonzero(_share(word) == share)
            side = frequent.side(word)
            copies = np.where(x["kind"] == 2, side * side, side).astype(np.int64)
            for lo in range(0, len(mine), 10_000):
                which = owners(copies[mine[lo : lo + 10_000]])
                turn = np.arange(len(which)) - np.repeat(np.cumsum(copies[mine[lo : lo + 10_000]]) - copies[mine[lo : lo + 10_000]], copies[mine[lo : lo + 10_000]])
                at, turn = mine[lo : lo + 10_000][which], turn.astype(np.uint64)
                kind, s = x["kind"][at], side[at]
                with np.errstate(over="ignore"):
                    row = np.where(kind == 2, turn // s, np.where(kind == 1, turn, pair[at] % s))
                    column = np.where(kind == 2, turn % s, np.where(kind == 1, gram[at] % s, turn))
                    unit = _Frequent.unit(word[at], s, row, column)
                out = dict.fromkeys(_names(depth), np.zeros(len(at), np.int64)) | {"unit": unit, "who": -kind.astype(np.int64), "next": np.where(kind == 1, gram[at], np.uint64(0)), "times": x["times"][at]}
                out |= {f"c{n}": np.where(kind == n, gram[at], np.uint64(0)) for n in range(3, depth + 1)}
                yield pa.RecordBatch.from_pydict({c: _longs(v) for c, v in out.items()})

    return run


def _rows(frequent: _Frequent, depth: int, share: int):
    """One row for each distinct (n-gram of up to `depth` - 1 words, next word) of a document whose last word is of this share.

    unit: the word, or a part of a frequent word's rows; cN: hash of the N - 1 words up to here,
    0 where the text has fewer; next: 0 at the end of a text; times: places, and how often the
    document holds the word with the next one; ownN: how often it holds cN (c2: the word itself).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, grams, after in _places(batches, depth - 1):
            at = np.flatnonzero(_share(grams[0]) == share)
            doc, grams, after = doc[at], [g[at] for g in grams], after[at]
            with np.errstate(over="ignore"):
                whose = mix(doc.view(np.uint64) + np.uint64(1))
                top = reduce(lambda shorter, g: np.where(g != 0, g, shorter), grams)
                _, first, times = np.unique(_and(_and(top, after), whose), return_index=True, return_counts=True)
                side = frequent.side(grams[0])
                s = np.maximum(side, np.uint64(1))
                unit = np.where(side > 0, _Frequent.unit(grams[0], s, grams[1] % s, after % s), grams[0])
                pairs = _sums(_and(_and(grams[0], after), whose))
                own = [_sums(_and(g, whose)) for g in grams]
            out = {"unit": unit, "who": doc * 2 + (side > 0), "next": after} | {f"c{n}": grams[n - 2] for n in range(3, depth + 1)}
            out |= {f"owns{n}": _two(own[n - 2], own[n - 1] if n < depth else 0) for n in range(2, depth + 1, 2)}
            order = np.argsort(first)
            out = {c: v[first[order]] for c, v in out.items()} | {"times": _two(times[order], pairs[first[order]])}
            yield pa.RecordBatch.from_pydict({c: _longs(out[c]) for c in _names(depth)})

    return run


def _scored(order: int, alpha: float, depth: int):
    """doc, log, alone: the sum of the terms of each row of some units, where there are any, and how many of its places have their word divided by the words of the corpus."""
    step = float(np.log(alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in _names(depth)] for b in batches]
        if not parts:
            return
        x = {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(_names(depth))}
        parts.clear()
        who, real = x["who"], x["who"] >= 0
        unit, after = x["unit"].view(np.uint64), x["next"].view(np.uint64)
        here = np.where(real, _low(x["times"]), 0)
        inside = np.where(who & 1 == 0, here, 0)
        own = {n: x[f"owns{n - n % 2}"] >> 32 if n % 2 else _low(x[f"owns{n}"]) for n in range(2, depth + 1)}
        context = {2: unit} | {n: x[f"c{n}"].view(np.uint64) for n in range(3, depth + 1)}

        def rest(gram: np.ndarray, kind: int, own: np.ndarray) -> np.ndarray:
            return _sums(gram, inside + np.where(who == -kind, x["times"], 0)) - own

        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            word = rest(unit, 2, own[2])
            pair = rest(_and(context[3], unit), 3, own[3]) * (context[3] != 0) if order > 1 else np.zeros(len(unit))
            before = {2: word} | {n: pair if n == 3 else rest(_and(context[n], unit), n, own[n]) for n in range(3, order + 1)}
            alone = pair <= 0  # the place of the word itself: no n-gram longer than it is known
            log = np.where(alone & (word > 0), np.log(np.maximum(word, 1)) - step, 0.0)
            best = np.zeros(len(unit))
            for n in range(2, order + 1):  # the place after it
                gram = _and(context[n], after)
                if n == 2:
                    found = rest(gram, 1, x["times"] >> 32)
                else:
                    found = _sums(gram, here) - _sums(_and(gram, who.view(np.uint64)), here)
                known = (found > 0) & (context[n] != 0) & (after != 0)
                best = np.where(known, np.log(np.maximum(found, 1) / np.maximum(before[n], 1)) - n * step, best)
        kept = np.flatnonzero(real & (alone | (best != 0)))
        times = here[kept]
        yield pa.RecordBatch.from_arrays([pa.array(who[kept] >> 1), pa.array((log + best)[kept] * times), pa.array(alone[kept] * times)], ["doc", "log", "alone"])

    return run


def _sum_of(words: DataFrame, order: int, alpha: float, unit: int | None) -> tuple[DataFrame, int]:
    """(doc, log, alone: sums over all words; words of the corpus)."""
    depth = max(order, 3)  # the n-gram of two words tells whether a place falls back to its word
    schema = ", ".join(f"{c} long" for c in _names(depth))
    corpus = words.agg(F.sum("n_words")).first()[0] or 0
    unit = unit or min(UNIT_ROWS[1], max(UNIT_ROWS[0], corpus // 200))
    # where a word is rare, places are left out, half a unit at most in all: none of more than two units is missed, and corpus / unit words at most are gathered
    common = words.mapInArrow(_common(unit / max(1, corpus) / 2), "word long, times long")
    hot = common.groupBy("word").agg(F.sum("times").alias("times")).where(F.col("times") > 1.5 * unit).collect()
    frequent = _Frequent([tuple(r) for r in hot], unit)
    spanning = None
    if hot:  # what stands in one document only has no use
        parts = words.mapInArrow(_spanning(frequent, depth), "kind int, word long, pair long, gram long, times long, docs long")
        spanning = written(parts.groupBy("kind", "word", "pair", "gram").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).where("docs > 1"), "lm-spanning")
    tasks = max(1, -(-corpus // (SHARES * TASK_ROWS)))
    out = []
    for share in range(SHARES):
        rows = words.select("id", "words").mapInArrow(_rows(frequent, depth, share), schema)
        if spanning is not None:
            rows = rows.unionAll(spanning.mapInArrow(_dealt(frequent, depth, share), schema))
        terms = rows.repartition(tasks, "unit").mapInArrow(_scored(order, alpha, depth), "doc long, log double, alone long")
        out.append(written(terms.groupBy("doc").agg(F.sum("log").alias("log"), F.sum("alone").alias("alone")), "lm-sums"))
    return reduce(DataFrame.unionAll, out).groupBy("doc").agg(F.sum("log").alias("log"), F.sum("alone").alias("alone")), corpus


def _longest(n_words: Column, order: int) -> Column:
    """Sum over the places of a text of the words of the longest n-gram that ends there."""
    full = F.greatest(n_words - order + 1, F.lit(0))
    short = F.least(n_words, F.lit(order - 1))
    return full * order + short * (short + 1) / 2


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, key: str = "doc_id", column: str = "text", unit: int | None = None) -> DataFrame:
    """key, n_words, log_score (sum of natural logarithms), mean_log_score of every whole text.

    For each word the longest n-gram, of `order` words at most, that other texts contain
    gives count / count of its context; every shorter step costs a factor `alpha`, and a
    word of no other text scores as one in all words. Counts are of all rows: a repeated
    row vouches for its copy. Null and empty texts have 0 words, score 0 and a null mean;
    a null or repeated key is scored row by row like any other; an empty table gives an
    empty result. An n-gram is one row of each text however often it stands there. Words of
    more than twice `unit` places (`unit`: 1/200 of the corpus, 50,000 to 750,000, if none is given)
    are cut into units, so that no word's rows are one task's.
    """
    spark = docs.sparkSession

    def make() -> DataFrame:
        rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(F.col(column), F.lit("")).alias("text"))
        kind = rows.schema["key"].dataType.simpleString()
        # a file's dictionary of hashes keeps a word at some two bytes
        words = written(rows.mapInArrow(_read, f"id long, key {kind}, n_words long, words array<long>"), "lm-words", compression="zstd", **{"parquet.dictionary.page.size": 16 << 20})
        sums, corpus = _sum_of(words, order, alpha, unit)
        n = F.col("n_words")
        others = F.greatest(F.lit(1), F.lit(corpus) - n)
        log = F.col("log") - F.col("alone") * F.log(others) + _longest(n, order) * float(np.log(alpha))
        out = words.select("id", "key", "n_words").join(sums.withColumnRenamed("doc", "id"), "id", "left")
        return out.select(F.col("key").alias(key), "n_words", F.when(n > 0, log).otherwise(0.0).alias("log_score"), F.when(n > 0, log / n).alias("mean_log_score"))

    with shuffles_removed(spark):
        return settled(make, spark, "lm-scores")
