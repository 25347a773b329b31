"""Largest inner products by vantage-point trees, one tree for each shard of the vectors.

Inner products become distances by one more component: with R the largest norm of a shard, x is taken as
(x, sqrt(R^2 - |x|^2)) and a query, scaled to length R, as (q, 0); then |q - x|^2 = 2 R^2 - 2 q.x, so the nearest are
those with the largest products.  A node keeps a vantage point and the ranges of distances from it inside and outside its median
radius.  The triangle inequality bounds how near a query can come to either part; a part is skipped when
``factor`` times the bound exceeds the distance of the worst neighbour held.  Factor 1 is exact, larger
factors skip more.

Shards are dealt by a hash, so neither a cluster nor a vector that occurs very often fills one.  Queries go in
blocks past the trees of a group of shards, one tree at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS, BLOCK_QUERIES, GROUPS, LEAF = 1024, 256, 4, 256
MARGIN = 1e-9  # relative: products are screened by matrix products, then summed exactly
TREE = "dim int, shard int, ids binary, vectors binary, nodes binary"


@dataclass
class Tree:
    """Rows in tree order; node columns: begin, end, split, inside low and high, outside low and high, children."""

    ids: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        norm = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        full = np.column_stack((vectors.astype(np.float64), np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))))
        place = np.arange(len(ids))
        nodes: list[list[float]] = []

        def grow(a: int, b: int) -> int:
            me = len(nodes)
            nodes.append([a, b, -1, 0, 0, 0, 0, -1, -1])
            if b - a <= LEAF:
                return me
            centre = full[place[a:b]].mean(0)
            far = ((full[place[a:b]] - centre) ** 2).sum(1).argmax()  # a point at the rim splits best
            place[[a, a + far]] = place[[a + far, a]]
            d = np.sqrt(((full[place[a + 1 : b]] - full[place[a]]) ** 2).sum(1))
            if d.max() - d.min() <= MARGIN * max(d.max(), 1e-300):
                return me  # all equally far: no radius parts them
            by = np.argsort(d, kind="stable")
            place[a + 1 : b], d = place[a + 1 : b][by], d[by]
            half = max(1, len(d) // 2)
            nodes[me][2:7] = [a + 1 + half, d[0], d[half - 1], d[half], d[-1]]
            nodes[me][7] = grow(a + 1, a + 1 + half)
            nodes[me][8] = grow(a + 1 + half, b)
            return me

        if len(ids):
            grow(0, len(ids))
        return cls(ids[place], vectors[place], np.array(nodes, np.float64).reshape(-1, 9))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, component by component, so equal rows give equal sums."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d].astype(np.float64) * vectors[:, d]
    return total


class Search:
    """The best ``k`` of a block of queries over any number of trees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.queries, self.k, self.factor = ids, queries.astype(np.float64), k, factor
        self.norm = np.einsum("ij,ij->i", self.queries, self.queries)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.leaves = 0

    def offer(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray) -> None:
        """Take the rows into the lists of the queries ``at`` where they are good enough; ``rough`` has their products."""
        slack = MARGIN * np.sqrt(np.maximum(self.norm[at], 1e-300)) * self.radius
        q, v = np.nonzero(rough >= (self.score[at, -1] - slack)[:, None])
        other = ids[v] != self.ids[at[q]]
        q, v = q[other], v[other]
        if not len(q):
            return
        exact = products(self.queries[at[q]], vectors[v])
        own, start = np.unique(q, return_index=True)
        count = np.diff(np.append(start, len(q)))
        wide = int(count.max())
        score = np.full((len(own), self.k + wide), -np.inf)
        found = np.full((len(own), self.k + wide), np.iinfo(np.int64).max)
        rows = at[own]
        score[:, : self.k], found[:, : self.k] = self.score[rows], self.found[rows]
        r = np.repeat(np.arange(len(own)), count)
        c = self.k + np.arange(len(q)) - np.repeat(start, count)
        score[r, c], found[r, c] = exact, ids[v]
        best = np.lexsort((found, -score), axis=-1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, best, 1)
        self.found[rows] = np.take_along_axis(found, best, 1)

    def run(self, tree: Tree) -> None:
        if len(tree.ids):
            self.tree = tree
            self.radius = float(np.sqrt(np.einsum("ij,ij->i", tree.vectors, tree.vectors, dtype=np.float64).max()))
            self.visit(0, np.arange(len(self.ids)))

    def distance(self, product: np.ndarray, at: np.ndarray) -> np.ndarray:
        scale = self.radius / np.sqrt(np.maximum(self.norm[at], 1e-300))
        return np.sqrt(np.maximum(2 * self.radius**2 - 2 * scale * product, 0))

    def visit(self, node: int, at: np.ndarray) -> None:
        tree = self.tree
        a, b, split, in_low, in_high, out_low, out_high, inside, outside = tree.nodes[node]
        a, b = int(a), int(b)
        if split < 0:
            self.leaves += len(at)
            for i in range(a, b, 1024):
                part = slice(i, min(i + 1024, b))
                self.offer(at, tree.ids[part], tree.vectors[part], self.queries[at] @ tree.vectors[part].T)
            return
        vantage = self.queries[at] @ tree.vectors[a]
        self.offer(at, tree.ids[a : a + 1], tree.vectors[a : a + 1], vantage[:, None])
        d = self.distance(vantage, at)
        bound = {
            int(inside): np.maximum(np.maximum(d - in_high, in_low - d), 0),
            int(outside): np.maximum(np.maximum(d - out_high, out_low - d), 0),
        }
        near = d <= (in_high + out_low) / 2
        for first, second, rows in ((int(inside), int(outside), near), (int(outside), int(inside), ~near)):
            for child in (first, second):
                worst = self.distance(self.score[at, -1], at)
                go = rows & ~(self.factor * bound[child] > worst * (1 + MARGIN) + MARGIN * self.radius)
                if go.any():
                    self.visit(child, at[go])


def usable(vector: Column) -> Column:
    """True for vectors with components, all of them finite numbers and not all of them zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def built(table):
    """Task function: the tree of one shard."""
    import pyarrow as pa

    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    tree = Tree.build(np.asarray(table.column("vec_id")), matrix(table.column("vector"), dim))
    blobs = [tree.ids.tobytes(), tree.vectors.tobytes(), tree.nodes.tobytes()]
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "vectors", "nodes"), blobs, strict=True)}})


def gathered(table):
    """Task function: one block of queries as two blobs."""
    import pyarrow as pa

    dim = table.column("dim")[0].as_py()
    ids, rows = np.asarray(table.column("vec_id")), matrix(table.column("vector"), dim)
    order = np.lexsort((*rows.T[::-1], ids))
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "query_ids": pa.array([ids[order].tobytes()], pa.binary()), "queries": pa.array([rows[order].tobytes()], pa.binary())})


def searched(k: int, factor: float, kind: str):
    """Task function over rows sorted by block and group: one search per block and group, one tree at a time."""
    import pyarrow as pa

    names = ["query_id", "copy", "vec_id", "score"]

    def results(search: Search):
        rows, columns = np.nonzero(np.isfinite(search.score))
        data = (search.ids[rows], rows, search.found[rows, columns], search.score[rows, columns])
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names=names)

    def run(batches):
        key = search = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                dim = row["dim"].as_py()
                now = (dim, row["block"].as_py(), row["grp"].as_py())
                if now != key:
                    if search is not None:
                        yield results(search)
                    blob = np.frombuffer(row["queries"].as_buffer(), kind).reshape(-1, dim)
                    key, search = now, Search(np.frombuffer(row["query_ids"].as_buffer(), np.int64), blob, k, factor)
                vectors = np.frombuffer(row["vectors"].as_buffer(), kind).reshape(-1, dim)
                nodes = np.frombuffer(row["nodes"].as_buffer(), np.float64).reshape(-1, 9)
                search.run(Tree(np.frombuffer(row["ids"].as_buffer(), np.int64), vectors, nodes))
        if search is not None:
            yield results(search)

    return run


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index: one row for each shard with its tree.  ``vectors`` has vec_id, vector (usable) and dim."""
    counts = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard_rows)).otherwise(shards)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), shards).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(built, TREE), "trees")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products of each query with the other rows.

    ``vectors`` needs vec_id and embedding; other columns are ignored.  Rows that are repeated in both count once; rows with a
    NULL id or an unusable vector take no part; rows with the query's id are its own.  Vectors meet only those of their length.
    Ties go to the smaller vec_id.  Fewer than ``k`` candidates are returned all.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    column = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), column.alias("vector"), is_query.alias("is_query"))
    rows = written(rows.withColumn("dim", F.size("vector")).dropDuplicates(["vec_id", "vector"]), "vectors")
    trees = build_index(rows.select("vec_id", "vector", "dim"), shard_rows).withColumn("grp", F.pmod("shard", F.lit(GROUPS)))
    queries = rows.where("is_query")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks)).cast("int"))
    queries = queries.groupBy("dim", "block").applyInArrow(gathered, "dim int, block int, query_ids binary, queries binary")
    tasks = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))).join(trees, ["dim", "grp"])
    tasks = tasks.select("dim", "block", "grp", "shard", "query_ids", "queries", "ids", "vectors", "nodes")
    tasks = tasks.repartition("dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "shard")
    found = tasks.mapInArrow(searched(k, factor, np.dtype(kind).str), "query_id long, copy int, vec_id long, score double")
    order = F.expr("row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id)").alias("rank")
    return found.select("query_id", order, "vec_id", "score").where(F.col("rank") <= k)
