"""Approximate nearest neighbours by cosine with a hierarchical navigable small-world graph per shard (operator 8).

Different vectors are dealt to shards by a hash; a shard has about `SHARD` of them. Its graph is grown by insertion: a
node's level falls off exponentially, and on each of its layers the graph so far is searched for near nodes, of which
up to M become neighbours by the usual rule (near ones first, none that is nearer to a chosen neighbour than to the
node); they link back, and a node with too many links chooses anew by the same rule. Nodes are inserted in batches that
grow with the graph, and those of a batch are candidates for each other, so building takes about n log n comparisons.

A graph is a few flat arrays: for each layer the nodes and the neighbours of each. Graphs are a written table, one row a
shard. Queries go to each shard, where a task holds one graph and takes up to `QUERIES` queries through it in blocks;
shard results are merged.

Equal vectors are one node with the k + 1 smallest of their different ids, which is all that an answer can need: a
vector that most rows share makes no large group. Scores are computed anew from the original vectors in double precision,
scaled by powers of two, so that squares stay in range and no digit changes.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates;
vectors are compared with those of their own length only; null ids take no part; rows alike in id and vector are one, and
different vectors of one id are queries and candidates of their own, though none for a query of that id; with fewer
candidates than k all that are found are returned; an empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Different vectors of a shard, about; queries that one task takes through one shard's graph, about.
SHARD, QUERIES = 16384, 16384
#: Neighbours of a node in the lowest layer and above it, candidates for them, and how many the search keeps.
LOW, HIGH, NEAR, KEEP = 24, 12, 48, 96
#: Nodes that each query's search goes on from at a time, and entries into a lower layer.
STEP, ENTRIES = 4, 12
#: Queries of a block, and nodes of an insertion, at most; and components that a step of a block gathers at most.
BLOCK, GATHER = 512, 1 << 24


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, also where squares of components would leave the range of floats."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a and b, in double precision."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a.astype(np.float64), b.astype(np.float64)))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def block_of(dim: int) -> int:
    return max(16, min(BLOCK, GATHER // (STEP * LOW * dim)))


def chosen(v: np.ndarray, candidates: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """For each row of candidates (nodes, different ones, -1 for none) with their similarities up to m neighbours."""
    by = np.argsort(-sim, axis=1, kind="stable")
    c, s = np.take_along_axis(candidates, by, 1), np.take_along_axis(sim, by, 1)
    between = np.matmul(v[c], v[c].transpose(0, 2, 1))  # of the candidates of one node
    taken = np.zeros(c.shape, bool)
    for k in range(c.shape[1]):
        closest = np.where(taken, between[:, k], -9).max(1)
        taken[:, k] = (closest < s[:, k]) & (taken.sum(1) < m) & (c[:, k] >= 0)
    # Slots that are left go to the nearest of the others.
    order = np.argsort(np.where(c < 0, 2, ~taken), axis=1, kind="stable")[:, :m]
    out = np.full((len(c), m), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def joined(v: np.ndarray, links: np.ndarray, new: np.ndarray, near: np.ndarray, sim: np.ndarray) -> None:
    """Link the nodes `new` to neighbours chosen from `near`, and these back, in the layer whose links are given."""
    m = links.shape[1]
    among = v[new] @ v[new].T
    np.fill_diagonal(among, -9)
    few = min(NEAR // 2, len(new) - 1)
    if few:
        c = np.argpartition(-among, few - 1, axis=1)[:, :few]
        near, sim = np.concatenate([near, new[c]], 1), np.concatenate([sim, np.take_along_axis(among, c, 1)], 1)
    if not near.shape[1]:
        return
    links[new] = chosen(v, near, np.where(near < 0, -9, sim), m)
    src, dst = np.repeat(new, m), links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    back = np.einsum("ij,ij->i", v[src], v[dst])
    by = np.lexsort((-back, dst))
    src, dst = src[by], dst[by]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst, "left")
    src, dst, rank = src[rank < m], dst[rank < m], rank[rank < m]  # the nearest of those that link to one node
    nodes, row = np.unique(dst, return_inverse=True)
    for at in range(0, len(nodes), BLOCK):
        mine = (row >= at) & (row < at + BLOCK)
        some = nodes[at : at + BLOCK]
        both = np.full((len(some), 2 * m), -1, np.int64)
        both[:, :m] = links[some]
        both[row[mine] - at, m + rank[mine]] = src[mine]
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[some] = chosen(v, both, np.where(both < 0, -9, np.einsum("qd,qed->qe", v[some], v[both])).astype(np.float32), m)


def build(v: np.ndarray, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, neighbours as places in nodes) of each layer, the lowest first. v has length 1."""
    n, rng = len(v), np.random.default_rng(seed)
    level = np.minimum(8, (-np.log(rng.random(n) + 1e-300) / np.log(HIGH)).astype(int))
    # The top layer stays small enough to be compared in full.
    counts = [int((level >= k).sum()) for k in range(9)]
    top = next(k for k in range(9) if counts[k] <= 2 * KEEP or k == 8)
    level = np.minimum(level, top)
    links = [np.full((n, HIGH if k else LOW), -1, np.int32) for k in range(top + 1)]
    order, at, size = rng.permutation(n), 0, block_of(v.shape[1])
    # From the top down, so that entries into lower layers are there from the beginning.
    order = order[np.argsort(-level[order], kind="stable")]
    high = np.flatnonzero(level == top)
    while at < n:
        new = np.sort(order[at : at + (32 if not at else min(size, max(32, at // 2)))])
        first = order[:at]
        entry, high = None, np.sort(first[level[first] == top])
        if at:
            sim = v[new] @ v[high].T
            few = min(ENTRIES, len(high))
            entry = high[np.argpartition(-sim, few - 1, axis=1)[:, :few]]
        for k in range(top, -1, -1):
            here = level[new] >= k
            if entry is None:
                joined(v, links[k], new[here], np.empty((here.sum(), 0), np.int64), np.empty((here.sum(), 0), np.float32))
                continue
            if not here.any():
                entry = filled(beam(v[new], v, links[k], entry, ENTRIES)[0])
                continue
            found, sim = beam(v[new], v, links[k], entry, NEAR)
            joined(v, links[k], new[here], found[here], sim[here])
            entry = filled(found[:, :ENTRIES])
        at += len(new)
    layers = []
    for k in range(top + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        place = np.full(n + 1, -1, np.int32)
        place[nodes] = np.arange(len(nodes), dtype=np.int32)
        layers.append((nodes, place[links[k][nodes]]))
    return layers


def filled(entry: np.ndarray) -> np.ndarray:
    """Entries, the first one in place of those that are missing."""
    return np.where(entry < 0, entry[:, :1], entry)


def beam(q: np.ndarray, v: np.ndarray, links: np.ndarray, entry: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Search one layer for all queries at once: places and similarities of up to `keep` near nodes, the nearest first;
    place -1 where there are fewer. entry: places to begin from, -1 for none."""
    rows = np.arange(len(q))[:, None]
    entry = entry.astype(np.int64)
    entry.sort(axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    seen = np.zeros((len(q), len(v) + 1), bool)  # the last column stands for place -1
    seen[:, -1] = True
    seen[rows, entry] = True
    sim = np.where(entry >= 0, np.einsum("qd,qed->qe", q, v[entry]), -9).astype(np.float32)
    place, done = entry.copy(), entry < 0
    while True:
        open_sim = np.where(done, -9, sim)
        best = np.argpartition(-open_sim, min(STEP, open_sim.shape[1]) - 1, axis=1)[:, :STEP]
        live = np.flatnonzero((np.take_along_axis(open_sim, best, 1) > -5).any(1))
        if not len(live):
            break
        b = best[live]
        go = np.take_along_axis(open_sim[live], b, 1) > -5
        done[live[:, None], b] = True
        new = np.where(go[:, :, None], links[place[live[:, None], b]], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new = np.where(seen[live[:, None], new], -1, new)
        seen[live[:, None], new] = True
        s = np.where(new >= 0, np.einsum("qd,qed->qe", q[live], v[new]), -9).astype(np.float32)
        width = place.shape[1] + new.shape[1]
        p2, s2, d2 = (np.full((len(q), width), x, t) for x, t in ((-1, place.dtype), (-9, np.float32), (True, bool)))
        p2[:, : place.shape[1]], s2[:, : place.shape[1]], d2[:, : place.shape[1]] = place, sim, done
        p2[live, place.shape[1] :], s2[live, place.shape[1] :], d2[live, place.shape[1] :] = new, s, new < 0
        top = np.argsort(-s2, axis=1, kind="stable")[:, :keep]
        place, sim, done = (np.take_along_axis(x, top, 1) for x in (p2, s2, d2))
    by = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(place, by, 1), np.take_along_axis(sim, by, 1)


def search(q: np.ndarray, v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Nodes near each query, -1 where there are fewer than asked for. q and v have length 1."""
    size, keep = block_of(v.shape[1]), max(k, KEEP)
    if len(q) > size:
        parts = [search(q[at : at + size], v, layers, k) for at in range(0, len(q), size)]
        wide = max(x.shape[1] for x in parts)
        return np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=-1) for x in parts])
    nodes, _ = layers[-1]
    sim = q @ v[nodes].T  # the top layer is small: all its nodes are compared
    n = min(ENTRIES, len(nodes))
    entry = nodes[np.argpartition(-sim, n - 1, axis=1)[:, :n]]
    for depth in range(len(layers) - 1, -1, -1):
        nodes, links = layers[depth]
        found, _ = beam(q, v[nodes], links, np.searchsorted(nodes, entry), ENTRIES if depth else keep)
        entry = np.where(found >= 0, nodes[found], -1)
        if depth:
            entry = filled(entry)
    return entry[:, :keep]


INDEX = "dim int, shard int, vectors binary, ids array<array<long>>, nodes array<binary>, links array<binary>"


def usable_rows(rows: DataFrame) -> DataFrame:
    """Different rows (id, vector) that take part."""
    good = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    return good.select("id", F.col("vector").cast("array<double>").alias("vector")).distinct()


def index(vectors: DataFrame, k: int) -> DataFrame:
    """One row a shard (and vector length) of a table id, vector. The flat arrays are stored as bytes."""
    # Only the smallest ids of equal vectors; Spark drops the others before it shuffles.
    few = usable_rows(vectors).withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = written(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")

    def one(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        x = np.array(table.column("vector").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dim)
        by = np.lexsort(x.T[::-1])  # the same graph however rows arrive
        ids = table.column("ids").to_pylist()
        layers = build(unit(x[by]))
        row = {"dim": dim, "shard": shard, "vectors": x[by].tobytes(), "ids": [ids[k] for k in by], "nodes": [a.astype("<i4").tobytes() for a, _ in layers], "links": [b.astype("<i4").tobytes() for _, b in layers]}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.Table.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

    return written(dealt.groupBy("dim", "shard").applyInArrow(one, INDEX), "hnsw")


class Graph:
    """A row of the index."""

    def __init__(self, row: pa.StructScalar, dim: int):
        self.x = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dim)
        self.v = unit(self.x)
        nodes = [np.frombuffer(a.as_buffer(), "<i4") for a in row["nodes"].values]
        links = [np.frombuffer(b.as_buffer(), "<i4").reshape(len(a), -1) for a, b in zip(nodes, row["links"].values, strict=True)]
        self.layers = list(zip(nodes, links, strict=True))
        lists = row["ids"].values
        self.starts, self.ids = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of up to k near rows without those of the query's own id."""
        found = search(unit(q), self.v, self.layers, 2 * k)
        at, col = np.nonzero(found >= 0)
        node = found[at, col]
        score = np.concatenate([cosine(q[at[j : j + 65536]], self.x[node[j : j + 65536]]) for j in range(0, len(at), 65536)])
        per = np.diff(self.starts)[node]
        pick = np.repeat(self.starts[:-1][node], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        row, vec, score = np.repeat(at, per), self.ids[pick], np.repeat(score, per)
        other = qid[row] != vec
        row, vec, score = row[other], vec[other], score[other]
        by = np.lexsort((vec, -score, row))
        row, vec, score = row[by], vec[by], score[by]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[top], vec[top], score[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: up to k near rows of `vectors` for each row of `queries` (both: id, vector), without
    rows of the query's own id; the nearest first, ties to the smaller id."""
    graphs = index(vectors, k)
    asked = usable_rows(queries).withColumn("dim", F.size("vector")).withColumn("row", F.xxhash64("id", "vector"))
    # A row a shard; and how many tasks its queries are dealt to.
    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    shards = written(graphs.select("dim", "shard").join(parts, "dim"), "shards")
    units = shards.agg(F.sum("parts")).first()[0] or 1
    lists = shards.groupBy("dim", "parts").agg(F.collect_list("shard").alias("shards"))
    key = ["dim", "shard", "part"]
    held = graphs.join(shards, ["dim", "shard"]).select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.struct("vectors", "ids", "nodes", "links").alias("graph"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"))
    # The query set against every shard: each query is dealt to each of them once.
    dealt = asked.join(lists, "dim").select("dim", F.explode("shards").alias("shard"), F.pmod("row", F.col("parts")).alias("part"), F.lit(None).cast(held.schema["graph"].dataType).alias("graph"), "row", "id", "vector")
    # A task has one graph or a few, and each graph comes ahead of its queries.
    count = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), units)
    rows = held.unionByName(dealt).withColumn("is_query", F.col("id").isNotNull()).repartition(count, *key).sortWithinPartitions(*key, "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            dim, asks = batch.column("dim").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(~asks | np.concatenate([[False], ~asks[:-1]]))
            bounds = sorted({0, *cuts.tolist(), len(asks)})
            for at, to in zip(bounds, bounds[1:], strict=False):
                if not asks[at]:
                    graph = Graph(batch.column("graph")[at], int(dim[at]))
                    continue
                part = batch.slice(at, to - at)
                qid, key = part.column("id").to_numpy(), part.column("row").to_numpy()
                q = np.array(part.column("vector").flatten().to_numpy(), np.float64).reshape(len(qid), -1)
                row, vec, score = graph.nearest(qid, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[row], pa.int64()), pa.array(key[row], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "row", "vec_id", "score"])

    found = rows.select("dim", "graph", "row", "id", "vector", "is_query").mapInArrow(run, "query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
