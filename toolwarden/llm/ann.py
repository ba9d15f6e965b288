"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt by a hash into shards of about ``SHARD``.  In each
shard a graph is grown: vectors enter in batches that double, a greedy beam
search on the graph so far proposes neighbours, and relaxed distance pruning
keeps those that no kept neighbour is closer to by the factor ``ALPHA``; the
reverse edges are pruned in the same way.  Queries, in blocks of ``QUERIES``,
run a beam search in every shard; the nearest of all shards are merged by their
exact cosine in double precision on the original vectors.

Copies of a vector enter the graph once, with the ``k + 1`` smallest ids, all
that a query can return of them; they are counted out before the shuffle, so a
vector that a third of all rows have is no burden.  A shard and a block have a
bounded size; a graph is built once and lives in a written table.

Defined results: vectors that are NULL, zero or hold NULL or non-finite
components, and rows without id, take no part; repeated rows are one candidate;
vectors of another dimension than the query's are no candidates; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SHARD = 8192
QUERIES = 32_768
#: Shard numbers of one vector length.
SPREAD = 4_000_000_000
DEGREE = 32
BEAM_BUILD, BEAM_SEARCH = 64, 96
ALPHA = 1.2
#: Vectors that enter, and queries that search, at a time.
BATCH = 256


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def beam(queries: np.ndarray, points: np.ndarray, graph: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and distances (1 - cosine) that greedy search keeps for each query, nearest
    first; -1 and infinity where there are fewer.  All queries step together."""
    n, degree = len(queries), graph.shape[1]
    nodes = np.full((n, width), -1, np.int64)
    far = np.full((n, width), np.inf, np.float32)
    done = np.zeros((n, width), bool)
    seen = np.zeros((n, len(points)), bool)
    nodes[:, 0] = start
    far[:, 0] = 1 - queries @ points[start]
    seen[:, start] = True
    rows = np.arange(n)
    active = rows
    while len(active):
        open_ = np.where(done[active] | (nodes[active] < 0), np.inf, far[active])
        at = open_.argmin(axis=1)
        more = np.isfinite(open_[np.arange(len(active)), at])
        active, at = active[more], at[more]
        if not len(active):
            break
        done[active, at] = True
        near = graph[nodes[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, nodes[active, at][:, None])] = True
        gap = 1 - np.einsum("qd,qrd->qr", queries[active], points[np.where(fresh, near, 0)])
        gap = np.where(fresh, gap, np.inf)
        all_far = np.concatenate([far[active], gap], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        all_nodes = np.concatenate([nodes[active], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[active], np.zeros((len(active), degree), bool)], axis=1)
        far[active] = np.take_along_axis(all_far, best, 1)
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return nodes, far


def prune(own: np.ndarray, found: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``own`` the kept neighbours among ``found`` (-1: none): nearest first,
    leaving out what a kept one is closer to by ``alpha``."""
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = np.where(found == own[:, None], -1, found)
    vectors = points[np.maximum(found, 0)]
    # Squared lengths between unit vectors: the measure that relaxation needs.
    gap = 2 - 2 * np.einsum("nd,ncd->nc", points[own], vectors)
    gap = np.where(found < 0, np.inf, np.maximum(gap, 0))
    order = np.argsort(gap, axis=1, kind="stable")
    found, gap = np.take_along_axis(found, order, 1), np.take_along_axis(gap, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = found >= 0
    kept = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        kept[has, k] = found[has, pick[has]]
        between = np.maximum(2 - 2 * np.einsum("nd,ncd->nc", vectors[rows, pick], vectors), 0)
        alive &= ~(has[:, None] & (alpha * alpha * between <= gap))
        alive[rows, pick] = False
    return kept


def grow(points: np.ndarray, degree: int = DEGREE, width: int = BEAM_BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph over unit vectors, and the node where searches start."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    centre = points.mean(axis=0)
    start = int((points @ centre).argmax())
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        nodes, _ = beam(points[batch], points, graph, start, width)
        # The members of a batch do not see each other in the graph: propose the nearest of them, too.
        if len(batch) > 1:
            close = points[batch] @ points[batch].T
            np.fill_diagonal(close, -np.inf)
            some = min(8, len(batch) - 1)
            mates = batch[np.argpartition(-close, some - 1, axis=1)[:, :some]]
            nodes = np.concatenate([nodes, mates], axis=1)
        graph[batch] = prune(batch, nodes, points, degree, alpha)
        _reverse(graph, batch, points, degree, alpha)
        at += len(batch)
        size = min(BATCH, size * 2)
    return graph, start


def _reverse(graph: np.ndarray, batch: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    to, by = graph[batch].ravel(), np.repeat(batch, degree)
    to, by = to[to >= 0], by[to >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    wide = np.full((len(targets), degree + counts.max(initial=0)), -1, np.int64)
    wide[:, :degree] = graph[targets]
    row = np.repeat(np.arange(len(targets)), counts)
    wide[row, degree + np.arange(len(to)) - np.repeat(first, counts)] = by
    held = (wide >= 0).sum(axis=1)
    room = held <= degree
    if room.any():
        graph[targets[room]] = -np.sort(-wide[room], axis=1)[:, :degree]
    if (~room).any():
        crowded = wide[~room]
        graph[targets[~room]] = prune(targets[~room], crowded, points, degree, alpha)


def _vectors(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    return np.asarray(flat, dtype).reshape(len(column), -1)


INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("near", T.ArrayType(T.IntegerType())),
    T.StructField("node", T.IntegerType()), T.StructField("start", T.IntegerType()),
])


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``vector, ids``: every distinct usable vector with its k + 1 smallest ids."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    smallest = Window.partitionBy("vector").orderBy("id")
    rows = usable.groupBy("vector", "id").agg(F.count("*").alias("c"))
    rows = rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    return rows.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def index(distinct: DataFrame) -> DataFrame:
    """Graphs over all distinct vectors: one row per vector, nodes numbered within the shard."""
    sizes = distinct.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    shards = sizes.select("d", F.ceil(F.col("n") / SHARD).alias("shards"))
    dealt = distinct.withColumn("d", F.size("vector")).join(shards, "d")  # a row per dimension
    dealt = dealt.withColumn(
        "shard", F.col("d").cast("long") * SPREAD + F.pmod(F.xxhash64("vector"), F.col("shards"))
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        graph, start = grow(_unit(_vectors(table["vector"])))
        n = table.num_rows
        near = pa.array([g[g >= 0].astype(np.int32) for g in graph], pa.list_(pa.int32()))
        return pa.table(
            [table["shard"], table["ids"], table["vector"], near, pa.array(range(n), pa.int32()), pa.array([start] * n, pa.int32())],
            names=INDEX.names,
        )

    rows = dealt.select("shard", "ids", "vector", F.col("ids")[0].alias("first"))
    return stored(rows.groupBy("shard").applyInArrow(build, INDEX), "graphs")


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; scaled first, so that squares neither vanish nor overflow."""
    q = query / np.abs(query).max()
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (v @ q) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


HITS = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
])


def search(graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for ``queries`` (``query_id, vector``)."""
    dimension = F.floor(F.col("shard") / SPREAD)
    shards = graphs.groupBy(dimension.alias("d")).agg((F.max("shard") % SPREAD).alias("last"))  # a row per dimension
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.withColumn("d", F.size("vector").cast("long")).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    )
    # The stated query set, in blocks, against every shard.
    every_shard = F.explode(F.sequence(F.col("d") * SPREAD, F.col("d") * SPREAD + F.col("last"))).alias("target")
    left = asked.join(shards, "d").select(every_shard, F.col("block").alias("part"), "query_id", "vector")
    right = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked_rows: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in HITS.names}
        if asked_rows.num_rows and held.num_rows:
            held = held.sort_by([("node", "ascending")])
            near = held["near"].to_pylist()
            graph = np.full((len(near), DEGREE), -1, np.int64)
            for i, g in enumerate(near):
                graph[i, : len(g)] = g
            original, ids = _vectors(held["vector"]), held["ids"].to_pylist()
            points, start = _unit(original), held["start"][0].as_py()
            wanted, names = _vectors(asked_rows["vector"]), asked_rows["query_id"].to_pylist()
            for first in range(0, len(names), BATCH):
                some = wanted[first : first + BATCH]
                nodes, _ = beam(_unit(some), points, graph, start, min(BEAM_SEARCH, max(k + 1, len(points))))
                for own, vector, found in zip(names[first : first + BATCH], some, nodes[:, : 4 * k], strict=True):
                    found = found[found >= 0]
                    scores = cosine(vector, original[found])
                    rows = [(-s, i) for s, n in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[n] if i != own]
                    for s, i in sorted(rows)[:k]:
                        out["query_id"].append(own)
                        out["vec_id"].append(i)
                        out["score"].append(-s)
        types = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(out[n], t) for n, t in zip(HITS.names, types, strict=True)], names=HITS.names)

    hits = left.groupBy("target", "part").cogroup(right.groupBy("shard", "block")).applyInArrow(run, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Search ``vectors`` (``vec_id, embedding``) for the neighbours of every row whose id is divisible by ``every``."""
    distinct = stored(distinct_vectors(vectors, k), "vectors")
    queries = (
        vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
        .where(F.col("query_id") % every == 0)
        .join(distinct.select("vector").distinct(), "vector", "left_semi")
        .distinct()
    )
    return search(index(distinct), queries, k)
