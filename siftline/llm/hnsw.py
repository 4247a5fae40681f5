"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

A graph is flat arrays: vectors, and per layer a table of neighbour positions (-1: none). It is built by inserting
batches of doubling size: a batch searches the graph so far and itself, keeps diverse neighbours, and links back.
Searches walk all queries of a block at once. Largest inner product becomes nearest by angle when every vector
gets one more coordinate that makes all norms equal (queries get zero there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import need, settle, table

NEAREST = 20
#: Neighbours of a node on upper layers; twice as many on the lowest.
DEGREE = 16
#: Width of the beam when inserting and when searching.
EF_BUILD = 96
EF_SEARCH = 128
#: Vectors of a shard at most (some 50 MB of arrays at 64 dimensions), and shards at least.
SHARD_ROWS = 65_536
LEAST_SHARDS = 8
#: Queries that walk together, and nodes that each expands in one step.
BLOCK = 512
EXPAND = 4
SEED = 42


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = SEED):
        """vectors: float64, distinct rows."""
        n = len(vectors)
        self.exact = vectors
        norms = (vectors * vectors).sum(axis=1)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        # Scores stay finite in single precision whatever the vectors' scale.
        self.scale = float(np.sqrt(norms.max(initial=0.0))) or 1.0
        self.data = (np.concatenate([vectors, extra[:, None]], axis=1) / self.scale).astype(np.float32)
        self.degree = degree
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(degree)).astype(int), 6)
        self.layers = [np.full((n, degree * (1 if k else 2)), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = -1
        order = rng.permutation(n)
        at, size = 0, 1
        while at < n:
            batch = order[at : at + size]
            self._insert(batch, level, ef)
            top = batch[np.argmax(level[batch])]
            if self.entry < 0 or level[top] > level[self.entry]:
                self.entry = int(top)
            at, size = at + size, min(max(2 * size, 1), 2048)
        self.level = level

    def _insert(self, batch: np.ndarray, level: np.ndarray, ef: int) -> None:
        start = np.full((len(batch), 1), self.entry)
        from_top = level[self.entry] if self.entry >= 0 else -1
        for layer in range(len(self.layers) - 1, -1, -1):
            mine = level[batch] >= layer
            old = np.full((len(batch), 1), -1)
            if self.entry >= 0 and layer <= from_top:
                wide = ef if mine.any() else 1
                found = np.concatenate([self._walk(self.data[batch[i : i + BLOCK]], start[i : i + BLOCK], layer, wide)[0] for i in range(0, len(batch), BLOCK)])
                start, old = found, found
            if mine.any():
                self._connect(batch[mine], old[mine], layer)

    def _connect(self, nodes: np.ndarray, found: np.ndarray, layer: int) -> None:
        """Neighbours for new nodes, from the walk and from the batch itself, and the links back."""
        for i in range(0, len(nodes), BLOCK):
            part = nodes[i : i + BLOCK]
            among = self.data[part] @ self.data[nodes].T
            among[np.arange(len(part)), np.arange(i, i + len(part))] = -np.inf
            k = min(2 * self.degree, len(nodes))
            near = nodes[np.argpartition(-among, k - 1, axis=1)[:, :k]]
            near[np.take_along_axis(among, np.argpartition(-among, k - 1, axis=1)[:, :k], axis=1) == -np.inf] = -1
            self.layers[layer][part] = self._diverse(part, np.concatenate([found[i : i + BLOCK], near], axis=1), self.layers[layer].shape[1])
        target = self.layers[layer][nodes]
        source = np.repeat(nodes, target.shape[1])
        target = target.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, begin, many = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(ends), BLOCK):
            e, m = ends[i : i + BLOCK], many[i : i + BLOCK]
            back = np.full((len(e), int(m.max())), -1)
            row = np.repeat(np.arange(len(e)), m)
            col = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            back[row, col] = source[begin[i] : begin[i] + m.sum()]
            self.layers[layer][e] = self._diverse(e, np.concatenate([self.layers[layer][e], back], axis=1), self.layers[layer].shape[1])

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates, nearest first, those nearer to it than to any chosen before; then the nearest of the rest."""
        ids = np.sort(candidates, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == nodes[:, None]] = -1
        score = np.where(ids >= 0, np.einsum("nd,ncd->nc", self.data[nodes], self.data[ids]), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, : 4 * most]
        ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
        vectors = self.data[ids]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, dtype=bool)
        blocked = ids < 0
        for c in range(ids.shape[1]):
            take = ~blocked[:, c] & (chosen.sum(axis=1) < most)
            chosen[:, c] = take
            blocked |= take[:, None] & (between[:, c, :] > score) & ~chosen
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, axis=1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _walk(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one layer: positions and scores, best first, -1 where there are fewer than ``ef``."""
        n = len(queries)
        links = self.layers[layer]
        ids = np.full((n, ef), -1, dtype=np.int64)
        score = np.full((n, ef), -np.inf, dtype=np.float32)
        done = np.zeros((n, ef), dtype=bool)
        width = min(ef, start.shape[1])
        ids[:, :width] = start[:, :width]
        score[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("nd,ncd->nc", queries, self.data[ids[:, :width]]), -np.inf)
        live = np.arange(n)
        step = min(EXPAND, ef)
        while len(live):
            open_ = ~done[live] & (ids[live] >= 0)
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            good = np.take_along_axis(open_, pick, axis=1)
            going = good.any(axis=1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            done[live[:, None], pick] |= good
            near = links[np.where(good, ids[live[:, None], pick], 0)].astype(np.int64)
            near[~good] = -1
            near = near.reshape(len(live), -1)
            every = np.concatenate([ids[live], near], axis=1)
            order = np.argsort(every, axis=1, kind="stable")
            by_id = np.take_along_axis(every, order, axis=1)
            again = np.zeros(every.shape, dtype=bool)
            np.put_along_axis(again, order[:, 1:], by_id[:, 1:] == by_id[:, :-1], axis=1)
            fresh = (near >= 0) & ~again[:, ef:]
            new_score = np.full(near.shape, -np.inf, dtype=np.float32)
            r, c = np.nonzero(fresh)
            new_score[r, c] = np.einsum("nd,nd->n", queries[live[r]], self.data[near[r, c]])
            near[~fresh] = -1
            all_score = np.concatenate([score[live], new_score], axis=1)
            best = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef] if all_score.shape[1] > ef else np.tile(np.arange(all_score.shape[1]), (len(live), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_score, best, axis=1), axis=1, kind="stable"), axis=1)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1)
            ids[live], score[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_score, all_done))
        return ids, score

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Positions found for each query, best first, -1 padded."""
        norm = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        q = np.concatenate([queries / np.where(norm > 0, norm, 1), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        out = []
        for i in range(0, len(q), BLOCK):
            part = q[i : i + BLOCK]
            at = np.full((len(part), 1), self.entry)
            for layer in range(int(self.level[self.entry]), 0, -1):
                at = self._walk(part, at, layer, 1)[0]
            out.append(self._walk(part, at, 0, ef)[0])
        return np.concatenate(out)


def _search(nearest: int, ef: int):
    """Rows sorted by shard, vectors before queries: builds each shard's graph, then streams its queries."""

    def answer(graph: Graph, ids: list[np.ndarray], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = _matrix(rows.column("v"))
        names = np.asarray(rows.column("id")).astype(np.int64)
        for i in range(0, len(vectors), BLOCK):
            q, name = vectors[i : i + BLOCK], names[i : i + BLOCK]
            found = graph.search(q, ef)
            score = np.einsum("ncd,nd->nc", graph.exact[found], q) if found.shape[1] else np.zeros(found.shape)
            out_q, out_v, out_s = [], [], []
            for k in range(len(q)):
                at = found[k][found[k] >= 0]
                # one sum for each pair, in one order: equal vectors have equal scores
                exact = (graph.exact[at] * q[k]).sum(axis=1)
                many = [ids[a][ids[a] != name[k]] for a in at]
                who = np.concatenate(many) if many else np.zeros(0, np.int64)
                what = np.repeat(exact, [len(m) for m in many])
                best = np.lexsort((who, -what))[:nearest]
                out_q.append(np.full(len(best), name[k]))
                out_v.append(who[best])
                out_s.append(what[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, held, ids = None, None, [], []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            shards = np.asarray(batch.column("shard"))
            kinds = np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                part = rows.slice(begin, end - begin)
                if shards[begin] != shard:
                    shard, graph, held, ids = shards[begin], None, [], []
                if kinds[begin] == 0:
                    held.append(_matrix(part.column("v")))
                    ids += [np.array(x) for x in part.column("ids").to_pylist()]
                elif held or graph:
                    if graph is None:
                        graph, held = Graph(np.concatenate(held)), []
                    yield from answer(graph, ids, part.combine_chunks())

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def nearest_neighbours(
    vectors: DataFrame,
    is_query,
    nearest: int = NEAREST,
    ef: int = EF_SEARCH,
    shard_rows: int = SHARD_ROWS,
    least_shards: int = LEAST_SHARDS,
    vector: str = "embedding",
) -> DataFrame:
    """For each row of ``vectors`` (vec_id, ``vector``) that fulfils ``is_query``, the ``nearest`` other rows found.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision; nearest first, ties to the
    smaller vec_id. A query's candidates are all rows but those of its own id; with fewer than ``nearest`` all are found.

    Vectors that are null, zero, or hold null or non-finite components, and rows without id, take no part. Of
    different vectors under one id the least counts; repeated rows count once. Equal vectors are one node with the
    smallest ids it needs, so a very common vector costs no more than a rare one. Vectors of different length never meet. An
    empty table gives an empty result; other columns are not looked at.
    """
    need(vectors, "vec_id", vector)
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(v).alias("v"))
    rows = settle(rows, "vectors")
    first = Window.partitionBy("v").orderBy("id")
    nodes = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= nearest + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    shards = max(least_shards, -(-rows.count() // shard_rows))
    length = F.size("v").cast("long") * shards
    graph = nodes.select((F.pmod(F.xxhash64("v"), F.lit(shards)) + length).alias("shard"), F.lit(0).alias("kind"), F.element_at("ids", 1).alias("id"), "v", "ids")
    asked = rows.filter(is_query(F.col("id"))).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), "id", "v"
    )
    queries = asked.select((F.col("s") + length).alias("shard"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("array<bigint>").alias("ids"))
    # A shard is a task of its own, none has two: vectors of other lengths share the tasks, graph by graph.
    dealt = graph.unionByName(queries).repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int")).sortWithinPartitions("shard", "kind", "id")
    found = dealt.mapInArrow(_search(nearest, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
