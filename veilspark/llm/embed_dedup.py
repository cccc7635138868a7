"""Near duplicates of embeddings through navigable small-world graphs.

Rows are compared only under equal labels. Each label's vectors are dealt into shards of
bounded size, and a hierarchical navigable small-world graph is built for each shard. The
vectors of every shard query the graphs of all shards of their label (each pair of shards
once); beams widen until an audit against brute force finds nothing missed. Cosines are
verified in double precision and the links' components united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .vectors import matrix, packed, stored_as, valid_vectors

#: Vectors of a shard in expectation; neighbours of a node above and on the ground layer.
SHARD_ROWS, UPPER, GROUND = 2048, 12, 24
#: Beam at construction; first beam of a query; factor by which beams widen.
BUILD_BEAM, BEAM, WIDEN = 40, 32, 2
#: Audited queries of each pair of shards, and the recall of links they must show.
AUDIT, AUDIT_RECALL = 48, 1.0
#: Nodes that each query expands in one step of its walk.
STRIDE = 4


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's beam, best first, -1 where it is not full. All queries walk in step."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    todo = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    ids[:, 0], todo[:, 0] = start, True
    sims[:, 0] = np.einsum("qd,qd->q", q, x[start])
    seen[np.arange(n), start] = True
    live = np.arange(n)
    stride = min(STRIDE, beam)
    while True:
        live = live[todo[live].any(1)]
        if not len(live):
            return ids, sims
        waiting = np.where(todo[live], sims[live], -np.inf)
        pick = np.argpartition(-waiting, stride - 1, 1)[:, :stride] if stride < beam else np.tile(np.arange(beam), (len(live), 1))
        at = live[:, None]
        real = todo[at, pick]
        todo[at, pick] = False
        near = np.where(real[:, :, None], graph[np.where(real, ids[at, pick], 0)], -1).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # met through two nodes at once
        fresh = (near >= 0) & ~seen[at, near]
        seen[at, np.where(fresh, near, len(x))] = True
        cols = np.argsort(~fresh, 1, kind="stable")[:, : max(1, int(fresh.sum(1).max()))]
        near, fresh = np.take_along_axis(near, cols, 1), np.take_along_axis(fresh, cols, 1)
        s = np.where(fresh, np.einsum("qd,qmd->qm", q[live], x[near]), -np.inf).astype(np.float32)
        both = np.concatenate([sims[live], s], 1)
        best = np.argpartition(-both, beam - 1, 1)[:, :beam]
        sims[live] = np.take_along_axis(both, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), best, 1)
        todo[live] = np.take_along_axis(np.concatenate([todo[live], fresh], 1), best, 1)


def spread(x: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, best first, those that lie nearer to the row than to any kept before; then the best of the rest."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    m = ids.shape[1]
    own = x[ids]
    mutual = own @ own.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    for j in range(m):
        nearer = (kept & (mutual[:, j] >= sims[:, j, None])).any(1)
        kept[:, j] = (ids[:, j] >= 0) & ~nearer & (kept.sum(1) < keep)
    rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), 1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, rank, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


@dataclass
class SmallWorld:
    """Layers of neighbour tables over unit vectors; layers[0] is the ground."""

    x: np.ndarray
    layers: list[np.ndarray]
    top: int

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> SmallWorld:
        x = x.astype(np.float32)
        n = len(x)
        level = np.minimum(4, (-np.log(np.random.default_rng(seed).random(n)) / np.log(UPPER)).astype(int))
        order = np.argsort(-level, kind="stable")
        world = cls(x, [np.full((n, GROUND if i == 0 else UPPER), -1, np.int32) for i in range(int(level.max()) + 1)], int(order[0]))
        done = 1
        while done < n:
            batch = order[done : done + min(done, 256)]
            world._insert(batch, level[batch])
            done += len(batch)
        return world

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        """Nodes come in batches, high levels first; those of a batch also see each other."""
        at = np.full(len(batch), self.top)
        for layer in range(len(self.layers) - 1, -1, -1):
            table = self.layers[layer]
            mine = level >= layer
            ids, sims = beam_search(self.x, table, self.x[batch], at, BUILD_BEAM if mine.any() else 1)
            if mine.any():
                each = batch[mine]
                peers = self.x[each] @ self.x[each].T
                np.fill_diagonal(peers, -np.inf)
                m = min(BUILD_BEAM // 2, len(each))
                close = np.argpartition(-peers, m - 1, 1)[:, :m]
                s = np.concatenate([sims[mine], np.take_along_axis(peers, close, 1)], 1)
                c = np.concatenate([ids[mine], each[close]], 1)
                c = np.where(np.isfinite(s), c, -1)
                table[each] = spread(self.x, each, c, np.where(c >= 0, s, -np.inf), table.shape[1])
                self._link_back(table, each)
            at = ids[np.arange(len(batch)), sims.argmax(1)]

    def _link_back(self, table: np.ndarray, each: np.ndarray) -> None:
        source = np.repeat(each, table.shape[1])
        to = table[each].ravel()
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        nodes, first, n = np.unique(to[order], return_index=True, return_counts=True)
        width = table.shape[1] + int(n.max(initial=0))
        c = np.full((len(nodes), width), -1, np.int64)
        c[:, : table.shape[1]] = table[nodes]
        c[np.repeat(np.arange(len(nodes)), n), table.shape[1] + np.arange(len(to)) - np.repeat(first, n)] = source[order]
        for lo in range(0, len(nodes), 256):
            part = np.sort(c[lo : lo + 256], 1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            s = np.where(part >= 0, np.einsum("qd,qmd->qm", self.x[nodes[lo : lo + 256]], self.x[part]), -np.inf)
            table[nodes[lo : lo + 256]] = spread(self.x, nodes[lo : lo + 256], part, s, table.shape[1])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.top)
        for table in reversed(self.layers[1:]):
            ids, sims = beam_search(self.x, table, q, at, 1)
            at = ids[:, 0]
        return beam_search(self.x, self.layers[0], q, at, min(beam, len(self.x)))


def links(world: SmallWorld, q: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of query x node: cosine at least `threshold`, as far as the beams find it.

    Queries whose beam is full of links get a wider one; so do all others while one of
    the audited queries with room in its beam misses a link that brute force finds. A
    sixteenth of the shard is the widest beam; what is still open then meets all nodes.
    """
    n, slack = len(world.x), np.float32(threshold - 1e-4)
    out = np.zeros((len(q), n), bool)
    q32 = q.astype(np.float32)
    audit = np.unique(np.linspace(0, len(q) - 1, AUDIT).astype(int))
    truth = q32[audit] @ world.x.T >= slack
    todo, beam = np.arange(len(q)), BEAM
    while len(todo):
        if beam * 16 > n:
            out[todo] = q32[todo] @ world.x.T >= slack
            break
        full = np.zeros(len(q), bool)
        for lo in range(0, len(todo), 512):
            part = todo[lo : lo + 512]
            ids, sims = world.search(q32[part], beam)
            hit = sims >= slack
            out[np.repeat(part, hit.sum(1)), ids[hit]] = True
            full[part] = hit.all(1)
        room = ~full[audit]
        missed = (truth & ~out[audit])[room].sum() > (1 - AUDIT_RECALL) * truth[room].sum()
        todo = np.arange(len(q)) if missed else np.flatnonzero(full)
        beam *= WIDEN
    return out


def verified(hits: np.ndarray, q: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the links whose cosine in double precision reaches the threshold."""
    a, b = np.nonzero(hits)
    good = np.concatenate([np.einsum("nd,nd->n", q[a[i : i + 65536]], x[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]) if len(a) else np.empty(0, bool)
    return a[good], b[good]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component within a shard."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(raw, dtype: str) -> np.ndarray:
    x = matrix(raw, dtype)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _built(threshold: float, dtype: str):
    """One row for a shard: its vectors, graph, links within and local components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        x = _unit(rows["raw"], dtype)
        world = SmallWorld.build(x)
        hits = links(world, x, threshold)
        hits |= hits.T
        np.fill_diagonal(hits, False)
        a, b = verified(hits, x, x, threshold)
        ids = rows["vec_id"].to_numpy(np.int64)
        part = ids[local_components(len(ids), a, b)]
        degree = np.bincount(a, minlength=len(ids)).astype(np.int64)
        graph = b"".join(t.astype("<i4").tobytes() for t in world.layers)
        return pd.DataFrame({
            "label": rows["label"].iloc[:1], "shard": rows["shard"].iloc[:1], "ids": [ids.tobytes()], "raw": [b"".join(rows["raw"])], "part": [part.tobytes()],
            "degree": [degree.tobytes()], "graph": [graph], "top": [world.top],
        })

    return run


def _crossed(threshold: float, dtype: str):
    """Links between two shards: partial degrees (b null) and links of local components (n 0)."""

    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)})]
        for g in graphs.itertuples():
            ids, part = np.frombuffer(g.ids, np.int64), np.frombuffer(g.part, np.int64)
            x = _unit([g.raw[i : i + len(g.raw) // len(ids)] for i in range(0, len(g.raw), len(g.raw) // len(ids))], dtype)
            flat, layers = np.frombuffer(g.graph, "<i4"), [len(ids) * GROUND]
            layers += [len(ids) * UPPER] * ((len(flat) - layers[0]) // (len(ids) * UPPER))
            tables = [t.reshape(len(ids), -1) for t in np.split(flat, np.cumsum(layers)[:-1])]
            world = SmallWorld(x.astype(np.float32), tables, g.top)
            for s in queries.itertuples():
                qids, qpart = np.frombuffer(s.ids, np.int64), np.frombuffer(s.part, np.int64)
                step = len(s.raw) // len(qids)
                q = _unit([s.raw[i : i + step] for i in range(0, len(s.raw), step)], dtype)
                a, b = verified(links(world, q, threshold), q, x, threshold)
                ends = np.unique(np.stack([qpart[a], part[b]], 1), axis=0)
                n = np.concatenate([np.bincount(a, minlength=len(qids)), np.bincount(b, minlength=len(ids))])
                both = np.concatenate([qids, ids])
                out += [pd.DataFrame({"a": both[n > 0], "b": -1, "n": n[n > 0]}), pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "n": 0})]
        return pd.concat(out).astype("int64")

    return run


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        for r in f.itertuples():
            yield pd.DataFrame({k: np.frombuffer(getattr(r, k), np.int64) for k in ("ids", "part", "degree")})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", column: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key (long), n_links, component_id, kept: one row for each row of `vectors`.

    n_links counts the other vectors of the same label whose cosine is at least
    `threshold`; component_id is the smallest key reachable by links; kept: it is the
    row's own. Vectors that are null, zero, not finite or not of the most frequent length,
    and rows without a label, link with nothing. Every row is a vector of its own: keys may
    repeat, and a row without a key links like any other (its component is null, and it is
    kept, unless it links with rows that have a key); an empty table gives an empty result.

    A hot label has more shards, of the same size; every shard meets every other of its
    label, so work within a label grows with the square of its shards. Of a group of near
    copies only counts and links between local components leave a task, never all pairs.
    """
    dtype = stored_as(vectors.schema[column].dataType)
    every = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("vector"), F.col(label).cast("string").alias("label"))
    every = written(every.withColumn("vec_id", F.monotonically_increasing_id()), "hnsw-vectors")  # the table fixes the numbers
    rows = valid_vectors(every.where("label is not null")).select("vec_id", "label", "vector").mapInPandas(_flattened(dtype), "vec_id long, label string, raw binary")
    rows = written(rows.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))), "hnsw-rows")
    shards = rows.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = rows.join(shards, "label").withColumn("shard", (F.col("deal") % F.col("shards")).cast("int"))
    built = dealt.groupBy("label", "shard").applyInPandas(_built(threshold, dtype), "label string, shard int, ids binary, raw binary, part binary, degree binary, graph binary, top int")
    built = written(built, "hnsw-graphs")
    many = built.join(shards, "label")
    graphs = many.where("shard > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shard") - 1))).select("label", "shard", "other", "ids", "raw", "part", "graph", "top")
    queries = many.toDF(*many.columns).where("shard < shards - 1").withColumn("later", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)))
    queries = queries.select("label", F.col("later").alias("shard"), F.col("shard").alias("other"), "ids", "raw", "part")
    by = ["label", "shard", "other"]
    cross = written(graphs.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(_crossed(threshold, dtype), "a long, b long, n long"), "hnsw-cross")
    own = built.select("ids", "part", "degree").mapInPandas(_members, "ids long, part long, degree long").withColumnsRenamed({"ids": "vec_id"})
    found = components(cross.where("n = 0").select("a", "b"))
    more = cross.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    parts = own.join(found.select(F.col("node").alias("part"), "component"), "part", "left").join(more, "vec_id", "left")
    parts = parts.select("vec_id", (F.col("degree") + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "part").alias("component_id"))
    parts = every.select("key", "vec_id").join(parts, "vec_id", "left").withColumn("component", F.coalesce("component_id", "vec_id"))
    least = parts.groupBy("component").agg(F.min("key").alias("component_id"))
    out = parts.drop("component_id").join(least, "component")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _flattened(dtype: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "raw": packed(f["vector"], dtype)})

    return run
