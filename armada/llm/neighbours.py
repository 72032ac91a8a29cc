"""Approximate nearest neighbours by inner product over a forest of
random-projection trees (operator 12).

Equal vectors are one point with its ``k`` + 1 smallest ids (no query needs
more of them), so copies never crowd a leaf. Points get one more coordinate
that brings all to one norm; the nearest point then is the one of largest
inner product. The forest is fitted on a bounded sample of points chosen by
hash (``SAMPLE``): each node splits its sample at the middle of a random
projection down to ``LEAF`` points. Every point is placed in one leaf of
every tree.

A search keeps one priority queue for all trees, ordered by the sum of
squared margins on the way, and opens leaves until they hold a share of the
index. The share is calibrated on the sample: the smallest one whose leaves
hold ``RECALL`` of the exact neighbours of ``PROBES`` sample points, so
structured vectors need few leaves and vectors without structure many. The
sample points in the opened leaves bound a query's last result from below;
candidates under the bound are not sent on, which loses none.

Leaf candidates are reranked by exact inner products in tiles of at most
about ``TILE`` points and ``TILE`` queries: a leaf with more of either is cut
into several tiles, so no group grows with the data.

Defined results: vectors that are NULL, empty, zero or hold NULL or
non-finite components take no part, as do vectors of another length than the
vector that comes first by id. Rows equal in id and vector are one row; rows
that share an id only are different rows, each may be found and each that is
asked answers. A NULL id is never asked and comes last among equal scores.
With ``k`` or fewer candidates in reach all are returned; a table without
usable vectors gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm import hot, storage

K = 20
EVERY = 20
TREES = 4
SAMPLE = 16_384
LEAF = 128
PROBES = 256
RECALL = 0.96
TILE = 4_096
SEED = 7


class Forest:
    """Trees in flat arrays. ``child`` >= 0 is a node, below 0 the leaf -child - 1;
    leaves are numbered through all trees."""

    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.child, self.roots, self.leaves = [], [], [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points)), leaf, rng))
        dims = points.shape[1]
        self.planes = np.array(self.planes, np.float64).reshape(-1, dims)
        self.cuts = np.array(self.cuts, np.float64)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)
        self.where = self.place(points)
        self.sizes = np.bincount(self.where.ravel(), minlength=self.leaves)

    def _grow(self, points, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            plane = rng.standard_normal(points.shape[1])
            plane /= np.linalg.norm(plane)
            on = points[rows] @ plane
            mid = np.sort(on)[len(on) // 2 - 1:len(on) // 2 + 1]
            cut = float(mid.mean())  # between two points, so that rounding moves neither across
            if mid[0] < cut < mid[1]:
                k = len(self.planes)
                self.planes.append(plane), self.cuts.append(cut), self.child.append([0, 0])
                for side, part in enumerate((rows[on < cut], rows[on >= cut])):
                    self.child[k][side] = self._grow(points, part, leaf, rng)
                return k
        self.leaves += 1
        return -self.leaves

    def place(self, points: np.ndarray) -> np.ndarray:
        """(n, trees) leaf of every point."""
        out = np.empty((len(points), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root, np.int64)
            while (rows := np.flatnonzero(at >= 0)).size:
                node = at[rows]
                side = np.einsum("nd,nd->n", points[rows], self.planes[node]) >= self.cuts[node]
                at[rows] = self.child[node, side.astype(np.int64)]
            out[:, t] = -at - 1
        return out

    def search(self, margins: np.ndarray, budget: float) -> list[int]:
        """Leaves in the order of the queue until their sample points reach ``budget``."""
        queue, found, mass = [(0.0, root) for root in self.roots], [], 0
        heapq.heapify(queue)
        m, child, sizes = margins.tolist(), self.child, self.sizes
        while queue and mass < budget:
            far, at = heapq.heappop(queue)
            if at < 0:
                found.append(-at - 1)
                mass += sizes[-at - 1]
                continue
            side = int(m[at] >= 0)
            heapq.heappush(queue, (far, int(child[at, side])))
            heapq.heappush(queue, (far + m[at] * m[at], int(child[at, 1 - side])))
        return found

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.planes.T - self.cuts


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Points with one more coordinate, all of length ``norm``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def aimed(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries scaled to length ``norm``; their further coordinate is zero."""
    x = x.astype(np.float64)
    return np.column_stack([x * (norm / np.sqrt((x * x).sum(1)))[:, None], np.zeros(len(x))])


def share_needed(forest: Forest, x: np.ndarray, norm: float, k: int = K, recall: float = RECALL, probes: int = PROBES) -> float:
    """Part of the sample (points counted once a leaf) that a search must open to meet ``recall``."""
    n = len(x)
    if n <= k + 1:
        return float(len(forest.roots))
    rows = np.linspace(0, n - 1, min(probes, n)).astype(np.int64)
    margins, needs = forest.margins(aimed(x[rows], norm)), []
    for q, m in zip(rows, margins):
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        near = np.argpartition(-scores, k)[:k]
        order = forest.search(m, np.inf)
        mass = np.zeros(forest.leaves)
        mass[order] = np.cumsum(forest.sizes[order])
        needs.append(mass[forest.where[near]].min(1))
    return float(np.quantile(np.concatenate(needs), recall)) / n


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from left to right."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return total


def _stack(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _points(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, v) rows that take part, each once, and (key, v, ids) of their distinct vectors; both written."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector_col, lambda x: x != 0)
    rows = vectors.where(F.col(vector_col).isNotNull() & fine & some).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    rows = storage.write_shared(rows.where(F.size("v") == (len(first[0].v) if first else 0)).distinct(), "vectors")
    smallest = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    kept = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    # Structs, because a list of plain values would leave a NULL id out.
    points = kept.groupBy("v").agg(F.collect_list(F.struct("id")).alias("ids")).select("v", F.col("ids.id").alias("ids"))
    return rows, storage.write_shared(points.withColumn("key", F.monotonically_increasing_id()), "points")


def _sampled(points: DataFrame, n: int, sample: int) -> np.ndarray:
    """At most ``sample`` points, those of smallest hash."""
    h = F.xxhash64("v")
    few = points if n <= sample else points.where(h < F.lit(min(2**63 - 1, int(1.1 * sample / n * 2**64) - 2**63)))
    rows = sorted(few.select(h.alias("h"), "v").collect(), key=lambda r: (r.h, r.v))[:sample]
    return np.array([r.v for r in rows])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
            trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row
    whose id is divisible by ``every``, the row itself left out."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, points = _points(vectors, id_col, vector_col, k)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest = points.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], out)
    norm, x = float(np.sqrt(largest)), _sampled(points, n, sample)
    forest = Forest(lifted(x, norm), trees, leaf)
    budget = max(share_needed(forest, x, norm, k) * len(x), k + 2)
    given = spark.sparkContext.broadcast((forest, x, norm, budget))  # at most ``sample`` vectors and as many planes a tree
    vector = points.schema["v"].dataType.simpleString()

    def place(batches):
        forest, _, norm, _ = given.value
        for batch in batches:
            if batch.num_rows:
                at = forest.place(lifted(_stack(batch.column("v")), norm))
                leaves = pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, leaves], [*batch.schema.names, "leaves"])

    def search(batches):
        forest, x, norm, budget = given.value
        inside = [[] for _ in range(forest.leaves)]
        for i, at in enumerate(forest.where.tolist()):
            for leaf in at:
                inside[leaf].append(i)
        inside, held = [np.array(i, np.int64) for i in inside], x.astype(np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _stack(batch.column("v"))
            leaves, floors = [], []
            for v, m in zip(q.astype(np.float64), forest.margins(aimed(q, norm))):
                leaves.append(forest.search(m, budget))
                near = held[np.unique(np.concatenate([inside[i] for i in leaves[-1]]))] @ v
                floors.append(np.partition(near, -k - 1)[-k - 1] if len(near) > k else -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.list_(pa.int32())), pa.array(np.array(floors, np.float64))],
                [*batch.schema.names, "leaves", "floor"])

    asked = rows.where(F.col("id") % every == 0)
    query_points = points.join(asked.select("v").distinct(), "v", "left_semi").select("key", "v")
    placed = storage.write_shared(points.select("key", "v", "ids").mapInArrow(
        place, f"key long, v {vector}, ids array<bigint>, leaves array<int>"), "placed")
    searched = storage.write_shared(query_points.mapInArrow(
        search, f"key long, v {vector}, leaves array<int>, floor double"), "searched")

    def tiles(table: DataFrame, count: str) -> DataFrame:  # a row for each leaf of the forest
        return table.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
            F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(count))

    cuts = F.broadcast(storage.write_shared(tiles(placed, "np").join(tiles(searched, "nq"), "leaf"), "tiles"))
    own = F.pmod(F.xxhash64("key"), F.col("np")).cast("int")
    left = placed.select("key", "v", "ids", F.explode("leaves").alias("leaf")).join(cuts, "leaf").select(
        "leaf", own.alias("p"), F.explode(F.expr("sequence(0, nq - 1)")).alias("q"), F.col("key").alias("point"), "v", "ids")
    own = F.pmod(F.xxhash64("key"), F.col("nq")).cast("int")
    right = searched.select("key", "v", "floor", F.explode("leaves").alias("leaf")).join(cuts, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0, np - 1)")).alias("p"), own.alias("q"), "key", "v", "floor")

    def rerank(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if points.num_rows and queries.num_rows:
            x, q, floor = _stack(points["v"]), _stack(queries["v"]), queries["floor"].to_numpy()
            xd, reach = x.astype(np.float64), np.linalg.norm(x.astype(np.float64), axis=1)
            for a in range(0, len(q), 256):
                part = q[a:a + 256].astype(np.float64)
                slack = 1e-12 * np.linalg.norm(part, axis=1)[:, None] * reach[None, :]
                rows, cols = np.nonzero(part @ xd.T >= floor[a:a + 256, None] - slack)
                found.append((rows + a, cols, exact_scores(q[rows + a], x[cols])))
        rows, cols, score = (np.concatenate(y) for y in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"key": queries["key"].take(pa.array(rows)), "point": points["point"].take(pa.array(cols)),
                         "ids": points["ids"].take(pa.array(cols)), "score": pa.array(score, pa.float64())})

    tile_cols = ["leaf", "p", "q"]
    met = left.groupBy(*tile_cols).cogroup(right.groupBy(*tile_cols)).applyInArrow(
        rerank, "key long, point long, ids array<bigint>, score double")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    # A point that several trees found counts once.
    top = (met.dropDuplicates(["key", "point"]).select("key", (F.col("key") == F.col("point")).alias("own"), "score", F.explode("ids").alias("id"))
           .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1))
    lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "own"))).alias("near"))
    asking = asked.groupBy("v").agg(F.count(F.lit(1)).alias("asking"))
    ready = storage.write_shared(asking.join(points.join(lists, "key").select("v", "near"), "v"), "answers")
    others = F.slice(F.filter("near", lambda r: ~(r["own"] & r["id"].eqNullSafe(F.col("id")))), 1, k)
    return (hot.join_per_key(asked, ready, "v", "asking")
            .select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "r"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score")))
