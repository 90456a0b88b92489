"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are dealt to the nearest of up to ``POINTS`` coarse vantage points, and those of a point to shards, each of which is a tree. A
query first meets the shards of its own point, which tells how near its k-th nearest is at most: its reach. Another point's shards are
met only if they can hold something nearer: with the distances of a point's vectors to it within [low, high], nothing is nearer to a
query at distance d from the point than d - high or low - d. Within a tree the same holds for the two sides of each vantage point. What
exceeds ``factor`` times the reach is left out: factor 1 is exact, less prunes more. Trees are descended by all queries of a block
at once, the nearer side first. The ``k`` nearest of all shards that a query met stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a shard (about), of a leaf, and queries of a block (about); most coarse vantage points of one number of dimensions.
SHARD, LEAF, BLOCK, POINTS = 4096, 128, 512, 64
#: Measured against brute force on made-up vectors of 4 to 32 dimensions on which trees prune, with and without clusters: recall at 10 is 0.995 or more
#: (with 0.25 it was 0.88 to 1). On the given ones hardly anything can be pruned and it is 1.
FACTOR = 0.5


#: Components above this are divided by the largest before they are squared.
LARGE = 1e140


@dataclass
class Node:
    at: int  # of the vantage point, or -1 for a leaf
    begin: int
    end: int
    near: Node | None = None
    far: Node | None = None
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # of distances to the vantage point, near and far side


class Tree:
    """A vantage-point tree over the rows of ``vectors``, reordered so that each leaf is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.ids, self.vectors, self.leaf = ids.copy(), vectors.astype(np.float64), leaf
        self.root = self._build(0, len(ids), np.random.default_rng(seed))

    def _build(self, begin: int, end: int, rng) -> Node:
        if end - begin <= self.leaf:
            return Node(-1, begin, end)
        # Of a few candidates, the vantage point that spreads a sample of the others most.
        sample = self.vectors[rng.integers(begin, end, 64)]
        tried = rng.integers(begin, end, 5)
        chosen = max(tried, key=lambda i: distances(self.vectors[i][None], sample)[0].std())
        self._swap(begin, chosen)
        d = distances(self.vectors[begin][None], self.vectors[begin + 1 : end])[0]
        half = len(d) // 2
        order = np.argpartition(d, half)  # by rank, so that equal distances split evenly too
        self.vectors[begin + 1 : end] = self.vectors[begin + 1 : end][order]
        self.ids[begin + 1 : end] = self.ids[begin + 1 : end][order]
        d = d[order]
        mid = begin + 1 + half
        bounds = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
        return Node(begin, begin, end, self._build(begin + 1, mid, rng), self._build(mid, end, rng), bounds)

    def _swap(self, a: int, b: int) -> None:
        self.vectors[[a, b]], self.ids[[a, b]] = self.vectors[[b, a]], self.ids[[b, a]]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found for each query (ties to the smaller id; -1 and infinity where there are fewer), never its own id.

        What lies beyond a query's ``reach`` need not be found.
        """
        best = Best(len(queries), k, reach)
        self._visit(self.root, np.arange(len(queries)), query_ids, queries.astype(np.float64), best, factor)
        return best.ids, best.dist

    def _visit(self, node: Node, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, factor: float) -> None:
        if not len(rows):
            return
        if node.at < 0:
            block = slice(node.begin, node.end)
            best.add(rows, near_distances(queries[rows], self.vectors[block], best.within(rows)), self.ids[block], query_ids)
            return
        d = distances(queries[rows], self.vectors[node.at][None])
        best.add(rows, d, self.ids[node.at : node.at + 1], query_ids)
        d = d[:, 0]
        low, high, low_far, high_far = node.bounds
        near_first = np.maximum(d - high, low - d) <= np.maximum(d - high_far, low_far - d)
        for first in (True, False):
            mine = near_first == first
            order = ((node.near, low, high), (node.far, low_far, high_far))
            for side, a, b in order if first else order[::-1]:
                gap = np.maximum(d - b, a - d)
                go = mine & ~(gap > factor * best.within(rows) + 1e-12)
                self._visit(side, rows[go], query_ids, queries, best, factor)


class Best:
    """The ``k`` nearest so far of each query, nearest first, ties to the smaller id."""

    def __init__(self, n: int, k: int, reach: np.ndarray | None = None):
        self.ids, self.dist, self.k = np.full((n, k), -1, np.int64), np.full((n, k), np.inf), k
        self.reach = np.full(n, np.inf) if reach is None else reach

    def within(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.dist[rows, -1], self.reach[rows])

    def add(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray, query_ids: np.ndarray) -> None:
        dist = np.where(query_ids[rows][:, None] == ids[None], np.inf, dist)
        some = (dist <= self.dist[rows, -1][:, None]).any(1) & np.isfinite(dist).any(1)
        rows, dist = rows[some], dist[some]
        if not len(rows):
            return
        every = np.concatenate((self.dist[rows], dist), 1)
        names = np.concatenate((self.ids[rows], np.broadcast_to(ids, dist.shape)), 1)
        # An id that repeats with infinity is nothing found; a finite one goes before it.
        names = np.where(np.isfinite(every), names, np.iinfo(np.int64).max)
        order = np.lexsort((names, every), axis=1)[:, : self.k]
        self.dist[rows] = np.take_along_axis(every, order, 1)
        self.ids[rows] = np.where(np.isfinite(self.dist[rows]), np.take_along_axis(names, order, 1), -1)


def near_distances(a: np.ndarray, b: np.ndarray, within: np.ndarray) -> np.ndarray:
    """``distances`` where they are not above ``within`` (one bound for each row of ``a``), and infinity elsewhere.

    Products sort out most pairs, with room for their rounding; the others are measured by differences.
    """
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) > LARGE:
        out = distances(a, b)
        return np.where(out <= within[:, None], out, np.inf)
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None]
    i, j = np.nonzero(squares * (1 - 1e-9) - 2 * (a @ b.T) <= within[:, None] ** 2)
    out = np.full((len(a), len(b)), np.inf)
    diff = a[i] - b[j]
    out[i, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, by differences rather than products; those beyond the largest double count as that."""
    largest = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if largest > LARGE:  # squares would overflow
        with np.errstate(over="ignore"):
            return np.minimum(distances(a / largest, b / largest) * largest, np.finfo(np.float64).max)
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (double) and its number of dimensions, for vectors that take part: neither null nor zero, all components finite, with an id."""
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        .withColumn("dim", F.size("embedding"))
    )


def _matrix(column) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(len(column), -1)


def _coarse(pool: DataFrame, shard: int) -> dict[int, np.ndarray]:
    """For each number of dimensions as many vectors as its shards, ``POINTS`` at most, those of the lowest hash."""
    wanted = pool.groupBy("dim").agg(F.least(F.ceil(F.count("*") / shard), F.lit(POINTS)).alias("wanted"))
    keyed = pool.select("dim", "vec_id", F.xxhash64("vec_id", "embedding").alias("draw"))
    first = keyed.withColumn("nr", F.row_number().over(Window.partitionBy("dim").orderBy("draw", "vec_id"))).where(F.col("nr") <= POINTS).join(wanted, "dim").where("nr <= wanted")
    drawn = pool.withColumn("draw", F.xxhash64("vec_id", "embedding")).join(F.broadcast(first.select("dim", "vec_id", "draw", "nr")), ["dim", "vec_id", "draw"])
    found: dict[int, list] = {}
    for r in drawn.orderBy("dim", "nr").collect():
        found.setdefault(r["dim"], []).append(r["embedding"])
    return {dim: np.array(rows, np.float64) for dim, rows in found.items()}


def _assigned(points, whole: bool):
    """Rows with the nearest coarse point, and the distance to it, or those to all points."""

    def run(batches):
        for batch in batches:
            dims, vectors = np.asarray(batch.column("dim")), batch.column("embedding")
            cell, away = np.zeros(len(dims), np.int32), [np.zeros(0)] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                d = distances(_matrix(vectors.take(pa.array(at))), points.value[int(dim)])
                cell[at] = d.argmin(1)
                for i, row in zip(at, d if whole else d.min(1)[:, None]):
                    away[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away, pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "away"])

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """A shard or block of one number of dimensions and point as one row: its ids, vectors and reaches, as bytes."""
    ids = np.asarray(table["vec_id"])
    order = np.argsort(ids, kind="stable")
    vectors, reach = _matrix(table["embedding"])[order], np.asarray(table["reach"])[order]
    return pa.table({"dim": table["dim"][:1], "cell": table["cell"][:1], "bin": table["bin"][:1], "ids": [ids[order].tobytes()], "vectors": [vectors.tobytes()], "reach": [reach.tobytes()]})


_GATHERED = "dim int, cell int, bin long, ids binary, vectors binary, reach binary"


def _searched(k: int, factor: float):
    def run(batches):
        last, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                if last != (row["dim"], row["cell"], row["bin"]):
                    last, tree = (row["dim"], row["cell"], row["bin"]), Tree(ids, vectors, seed=row["bin"])
                asked = np.frombuffer(row["query_ids"], np.int64)
                found, dist = tree.search(asked, np.frombuffer(row["queries"], np.float64).reshape(-1, row["dim"]), k, factor, np.frombuffer(row["reach"], np.float64))
                query, column = np.nonzero(np.isfinite(dist))
                yield pa.RecordBatch.from_arrays([pa.array(asked[query]), pa.array(found[query, column]), pa.array(dist[query, column])], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest vectors found for each query, nearest first, ties to the smaller id.

    Both frames hold vec_id and embedding. Vectors that are null or zero, or hold null or non-finite components, take no part, nor
    does a null id. Vectors are compared with those of as many dimensions. A query is never its own neighbour; queries that
    repeat an id count once (by the smallest vector), and of candidates that repeat an id the nearest counts. With too few
    candidates all are returned. An empty table on either side gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    pool = scratch.put(usable(vectors).distinct())  # it is counted, drawn from and dealt
    coarse = _coarse(pool, shard)
    points = vectors.sparkSession.sparkContext.broadcast(coarse)  # at most ``POINTS`` vectors for each number of dimensions
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    placed = "vec_id long, embedding array<double>, dim int, cell int, away array<double>"
    dealt = pool.select("vec_id", "embedding", "dim").mapInArrow(_assigned(points, False), placed).withColumn("reach", F.lit(float("inf")))
    asking = scratch.put(asked.where(F.col("dim").isin(*coarse)).select("vec_id", "embedding", "dim").mapInArrow(_assigned(points, True), placed))

    def gathered(df: DataFrame, size: int) -> DataFrame:
        """One row for each bin: about ``size`` rows by hash, for each number of dimensions and point."""
        bins = df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("bins"))
        binned = df.join(bins, ["dim", "cell"]).withColumn("bin", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("bins")))
        return binned.select("dim", "cell", "bin", "vec_id", "embedding", "reach").groupBy("dim", "cell", "bin").applyInArrow(_gathered, _GATHERED)

    dealt = scratch.put(dealt)
    shards = scratch.put(gathered(dealt, shard).drop("reach"))
    bounds = dealt.groupBy("dim", "cell").agg(F.min(F.col("away")[0]).alias("low"), F.max(F.col("away")[0]).alias("high"))

    def searched(df: DataFrame) -> DataFrame:
        blocks = gathered(df, block).select("dim", "cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), "reach")
        met = shards.join(blocks, ["dim", "cell"]).select("dim", "cell", "bin", "ids", "vectors", "query_ids", "queries", "reach")
        return scratch.put(met.mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double"))

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    near = searched(asking.withColumn("reach", F.lit(float("inf"))))
    known = best(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    # A row for each number of dimensions, of at most ``POINTS`` bounds.
    listed = bounds.groupBy("dim").agg(F.collect_list(F.struct("cell", "low", "high")).alias("cells"))
    far = asking.join(known, "vec_id", "left").join(listed, "dim").withColumnRenamed("cell", "own").withColumn("c", F.explode("cells"))
    d = F.try_element_at("away", F.col("c.cell") + 1)
    gap = F.greatest(d - F.col("c.high"), F.col("c.low") - d)
    far = far.where((F.col("c.cell") != F.col("own")) & (F.col("reach").isNull() | (gap <= factor * F.col("reach") + 1e-12)))
    rest = searched(far.select("vec_id", "embedding", "dim", F.col("c.cell").alias("cell"), F.coalesce("reach", F.lit(float("inf"))).alias("reach")))
    return best(near.union(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
