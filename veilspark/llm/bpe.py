"""Byte-level BPE encoding and decoding with numpy.

The distinct pre-tokens of a run of texts are laid out as padded matrices, one for each
length bucket. In every round each row merges its leftmost pair of least rank; a hashed
table gives the rank of a pair, finished rows leave the matrix and the rest close up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pairs import NO_PAIR, PairTable
from .pieces import Pieces, take_ranges
from .words import slices, texts_of

#: Cells of one padded matrix; bytes of texts that are worked on at once.
MATRIX_CELLS, SLICE_BYTES = 1_000_000, 1_000_000
#: Rows longer than this are merged one at a time by a heap.
WIDE = 512


class ByteBPE:
    """Encoder and decoder for a table of token bytes and their ranks; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, Pieces(pattern)
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.token = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int32),) * 3
        self.rank_of = PairTable(left, right, rank)

    @classmethod
    def from_tiktoken(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each)."""
        whole = np.fromiter((self.ranks.get(x, -1) for x in pieces), np.int32, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.flatnonzero((whole < 0) & (sizes > 0))
        at = at[np.argsort(sizes[at], kind="stable")]
        of, flat, counts = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]], [np.ones(int((whole >= 0).sum()), np.int64)]
        lo, wide = 0, int(np.searchsorted(sizes[at], WIDE, "right"))
        while lo < wide:
            width = 1 << int(sizes[at[lo]] - 1).bit_length()
            hi = min(int(np.searchsorted(sizes[at], min(width, WIDE), "right")), lo + max(1, MATRIX_CELLS // width))
            for part, into in zip(self._merge_rows([pieces[i] for i in at[lo:hi]], sizes[at[lo:hi]]), (of, flat, counts), strict=True):
                into.append(at[lo:hi][part] if into is of else part)
            lo = hi
        for i in at[wide:]:
            ids = self._merge_row(np.frombuffer(pieces[i], np.uint8))
            of.append(np.array([i]))
            flat.append(ids)
            counts.append(np.array([len(ids)]))
        of_, flat_, counts_ = map(np.concatenate, (of, flat, counts))
        order = np.argsort(of_, kind="stable")
        n = np.zeros(len(pieces), np.int64)
        n[of_] = counts_
        return take_ranges(flat_, (np.cumsum(counts_) - counts_)[order], counts_[order]), n

    def _merge_rows(self, rows: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers as they finished, their ids, how many of each)."""
        width = int(sizes.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(rows))
        of, flat, counts = [row[:0]], [ids[:0, 0]], [row[:0]]

        def finish(which: np.ndarray) -> None:
            held = ids[which]
            of.append(row[which])
            flat.append(held[held >= 0])
            counts.append((held >= 0).sum(1))

        while rank.shape[1] and len(row):
            j = rank.argmin(1)
            best = rank[np.arange(len(row)), j]
            live = best != NO_PAIR
            if not live.all():
                finish(~live)
                ids, rank, row, j, best = ids[live], rank[live], row[live], j[live], best[live]
                if not len(row):
                    break
            each, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > j[:, None]), 1)
            ids[each, j] = best
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= j[:, None]), 1)
            if rank.shape[1]:
                after = np.flatnonzero(j < rank.shape[1])
                rank[after, j[after]] = self.rank_of(ids[after, j[after]], ids[after, j[after] + 1])
                before = np.flatnonzero(j > 0)
                rank[before, j[before] - 1] = self.rank_of(ids[before, j[before] - 1], ids[before, j[before]])
        finish(np.ones(len(row), bool))
        return tuple(map(np.concatenate, (of, flat, counts)))

    def _merge_row(self, row: np.ndarray) -> np.ndarray:
        """A long row: a heap holds its pairs by rank and place, links skip merged places; about n log n steps."""
        ids = self.byte_id[row].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank_of(self.byte_id[row[:-1]], self.byte_id[row[1:]])
        known: dict[tuple[int, int], int] = {}
        at = np.flatnonzero(first != NO_PAIR)
        heap = [(r << 32) | i for r, i in zip(first[at].tolist(), at.tolist(), strict=True)]
        heapify(heap)

        def offer(i: int) -> None:
            rank = self._rank(known, ids[i], ids[after[i]])
            if rank != NO_PAIR:
                heappush(heap, (rank << 32) | i)

        while heap:
            best = heappop(heap)
            rank, i = best >> 32, best & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or self._rank(known, ids[i], ids[j]) != rank:
                continue  # one of the pair has merged since
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def _rank(self, known: dict[tuple[int, int], int], left: int, right: int) -> int:
        rank = known.get((left, right))
        if rank is None:
            rank = known[left, right] = int(self.rank_of(np.array([left], np.int32), np.array([right], np.int32))[0])
        return rank

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; every match of the pattern is encoded separately."""
        if (stay := self.pieces.forget()) is not None:
            self.flat = take_ranges(self.flat, self.starts[stay], self.counts[stay])
            self.counts = self.counts[stay]
            self.starts = np.cumsum(self.counts) - self.counts
        codes, counts, fresh = self.pieces.number(texts)
        if fresh:
            ids, n = self.encode_pieces(fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
            self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, n])
        n = self.counts[codes]
        ids = take_ranges(self.flat, self.starts[codes], n)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE.from_tiktoken(path, pattern)


def _encoded(path: str, pattern: str, key: str, column: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for lo, hi, texts in slices(batch, SLICE_BYTES, column):
                ids = bpe.encode(texts)
                raw = [x.astype("<u4").tobytes() for x in ids]
                cols = {
                    key: batch.column(key).slice(lo, hi - lo),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                }
                if with_ids:
                    cols["token_ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", column: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 and, if `with_ids`, token_ids. `path` is a rank file that every worker
    has. A null text counts as empty: no tokens and the digest of no bytes. Rows are
    independent of each other: repeated rows come out repeated, an empty table gives an
    empty result, columns besides `key` and `column` are not read. No shuffle.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(key, column).mapInArrow(_encoded(path, pattern, key, column, with_ids), schema)


def _decoded(path: str, pattern: str, key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            raw = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "text": pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())})

    return run


def decode_documents(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", column: str = "token_ids") -> DataFrame:
    """Texts of id arrays: key, text. A null array gives a null text."""
    return tokens.select(key, column).mapInArrow(_decoded(path, pattern, key, column), f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string")
