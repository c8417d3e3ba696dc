"""Approximate nearest neighbours by a forest of random-projection trees (operator 7).

Every node of a tree cuts space at the median of a random projection; medians come from a bounded sample, while
every vector is routed into one leaf per tree. A query walks all trees through one shared priority queue: the node
with the smallest distance to the boundaries crossed so far comes next, whichever tree it is in, until the
leaves it has opened hold enough vectors. Candidates are then reranked exactly, on the original vectors.

How many are enough is measured: for a bounded number of queries the true neighbours are found in
one pass over all vectors, and the budget is where the wanted share of them would have been met. Clustered data need few
leaves; data without structure need many, whatever the index.

Nearness is the inner product. Vectors get one more component that makes their norms equal, which turns it into a
distance for the trees. Leaves are dealt over parts of bounded size; a query goes once to
each part in which it opens leaves. Of equal vectors only the smallest ids can be
among the nearest, so the index holds k + 1 of each; a common vector costs no more.

Defined results: vectors null, empty, zero, or with a null or non-finite component take no part, nor do rows without a vec_id or of another
length than the most common one (the longer, if even); rows that repeat a vec_id and vector count once; a query has as many rows as there
are candidates found, at most k; no valid vector gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, table, written
from .registry import query

K = 20
TREES = 6
#: Vectors that medians are taken from, vectors a leaf should hold, sample vectors a leaf has at least.
SAMPLE = 20_000
LEAF = 512
LEAF_SAMPLE = 8
#: Index rows in a part, and queries whose true neighbours set the budget.
PART_ROWS = 24_576
CALIBRATION = 96
RECALL = 0.96

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


def fair(vector: Column) -> Column:
    """Finite in every component and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    rows = vectors.where(F.col("vec_id").isNotNull() & fair(F.col("embedding"))).select("vec_id", "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (lengths["d"] if lengths else 0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed the same way for every row."""
    return (vectors * one).sum(axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, nodes in heap order."""

    depth: int
    norm: float  # squared; vectors are lifted to it
    directions: np.ndarray  # trees x nodes x components
    medians: np.ndarray  # trees x nodes

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm - (vectors**2).sum(axis=1), 0))
        return np.concatenate((vectors, rest[:, None]), axis=1)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree, as trees x vectors."""
        points = self.lifted(vectors)
        out = np.empty((len(self.medians), len(points)), dtype=np.int64)
        for tree, (directions, medians) in enumerate(zip(self.directions, self.medians)):
            node = np.zeros(len(points), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", points, directions[node]) > medians[node]
                node = 2 * node + 1 + right
            out[tree] = node - (self.leaves - 1)
        return out

    def walk(self, one: np.ndarray) -> Iterator[int]:
        """All leaves, as tree * leaves + leaf, in the order of the shared queue."""
        point = np.append(one, 0.0)
        sides = (self.directions @ point) - self.medians
        queue = [(0.0, tree, 0) for tree in range(len(self.medians))]
        inner = self.leaves - 1
        while queue:
            bound, tree, node = heapq.heappop(queue)
            while node < inner:  # straight down on the query's side; the other side waits
                side = sides[tree, node]
                near = 2 * node + 1 + int(side > 0)
                heapq.heappush(queue, (max(bound, abs(side)), tree, 4 * node + 3 - near))
                node = near
            yield tree * self.leaves + node - inner


def plant(sample: np.ndarray, norm: float, depth: int, trees: int = TREES, seed: int = 3) -> Forest:
    random = np.random.default_rng(seed)
    nodes = max(1, (1 << depth) - 1)
    shape = Forest(0, norm, np.zeros((0, 0, 0)), np.zeros((0, 0)))
    points = shape.lifted(sample)
    directions = random.normal(size=(trees, nodes, points.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    medians = np.zeros((trees, nodes))
    for tree in range(trees):
        parts = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            part = parts.pop(node)
            at = points[part] @ directions[tree, node]
            medians[tree, node] = np.median(at) if len(part) else 0.0
            right = at > medians[tree, node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return Forest(depth, norm, directions, medians)


def true_neighbours(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Vectors of the k nearest of a bounded number of queries, by one pass over all rows."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("embedding", pa.list_(pa.float64()))])
    asked = rows.sparkSession.sparkContext.broadcast((queries, ids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids = asked.value
        for part in batches:
            own, vectors = part.column(0).to_numpy(), matrix(part.column(1))
            if not len(own):
                continue
            scores = queries @ vectors.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            top = np.argpartition(-scores, min(k, len(own)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(ids)), top.shape[1])
            at = top.ravel()
            yield batch(schema, q, own[at], scores[q, at], list(vectors[at]))

    found = rows.mapInArrow(nearest, "q long, vec_id long, score double, embedding array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= k) & (F.col("score") > float("-inf")))
    out: list[list] = [[] for _ in ids]
    for row in best.select("q", "embedding").collect():  # CALIBRATION x k rows
        out[row["q"]].append(row["embedding"])
    return [np.array(x, dtype=np.float64).reshape(len(x), queries.shape[1]) for x in out]


def budget(forest: Forest, sizes: np.ndarray, queries: np.ndarray, neighbours: list[np.ndarray], recall: float) -> int:
    """Vectors a query must be let to open until ``recall`` of the true neighbours are met."""
    needed: list[float] = []
    for one, true in zip(queries, neighbours):
        if not len(true):
            continue
        order = np.fromiter(forest.walk(one), np.int64)
        upto = np.empty(len(order), dtype=np.int64)
        upto[order] = np.cumsum(sizes[order])
        leaf = forest.route(true) + np.arange(len(forest.medians))[:, None] * forest.leaves
        needed.extend(upto[leaf].min(axis=0).tolist())
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


def search_part(index: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple]:
    """Exact nearest of the opened leaves of one part: (query_id, ids, scores)."""
    order = np.argsort(index.column("leaf").to_numpy(), kind="stable")
    leaf = index.column("leaf").to_numpy()[order]
    ids, vectors = index.column("vec_id").to_numpy()[order], matrix(index.column("embedding"))[order]
    asking, points = queries.column("query_id").to_numpy(), matrix(queries.column("vector"))
    opened = queries.column("leaves").combine_chunks()
    of = np.repeat(np.arange(len(asking)), np.diff(opened.offsets.to_numpy()))
    wanted = opened.flatten().to_numpy()
    by_leaf = np.argsort(wanted, kind="stable")
    of, wanted = of[by_leaf], wanted[by_leaf]
    held: list[list[np.ndarray]] = [[] for _ in asking]
    for number in np.unique(wanted):
        a, b = np.searchsorted(leaf, (number, number + 1))
        c, d = np.searchsorted(wanted, (number, number + 1))
        if a == b:
            continue
        for start in range(c, d, 512):
            who = of[start : min(d, start + 512)]
            scores = points[who] @ vectors[a:b].T
            scores[asking[who][:, None] == ids[None, a:b]] = -np.inf
            keep = min(k, b - a)
            # a product of matrices may round equal vectors apart: keep what is within rounding of the last place
            last = np.partition(scores, -keep, axis=1)[:, -keep]
            row, at = np.nonzero(scores >= np.maximum(last - 1e-9 * np.maximum(1, np.abs(last)), -1e300)[:, None])
            for place, members in zip(who, np.split(at, np.searchsorted(row, np.arange(1, len(who))))):
                held[place].append(members + a)
    for place, parts in enumerate(held):
        if parts:
            at = np.concatenate(parts)
            at = at[np.unique(ids[at], return_index=True)[1]]
            score = exact(vectors[at], points[place])
            top = np.lexsort((ids[at], -score))[:k]
            yield asking[place], ids[at][top], score[top]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest that are found for each query row."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("_r", F.dense_rank().over(first)).where(F.col("_r") <= k + 1).drop("_r").dropDuplicates()
    index = written(distinct, "vectors-index")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    about = index.agg(F.count("*").alias("n"), F.max(norm2).alias("norm")).first()
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def some(frame: DataFrame, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = frame.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(limit).collect()
        return np.array([r[0] for r in chosen], dtype=np.int64), np.array([r[1] for r in chosen], dtype=np.float64)

    _, sample = some(index, SAMPLE, 1)
    deepest = math.log2(max(1, len(sample) / LEAF_SAMPLE))
    depth = max(0, math.floor(min(deepest, math.log2(max(1, about["n"] / LEAF)) + 0.5)))
    forest = plant(sample, about["norm"], depth)
    shared = spark.sparkContext.broadcast(forest)
    leaves = TREES * forest.leaves
    parts = max(1, math.ceil(TREES * about["n"] / PART_ROWS))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # vectors travel in the type they came in
        for part in batches:
            points = matrix(part.column(1))
            if len(points):
                for tree, leaf in enumerate(shared.value.route(points)):
                    leaf = pa.array(leaf + tree * shared.value.leaves, pa.int32())
                    yield pa.RecordBatch.from_arrays([leaf, *part.columns], names=["leaf", "vec_id", "embedding"])

    kind = index.schema["embedding"].dataType.simpleString()
    placed = index.mapInArrow(routed, f"leaf int, vec_id long, embedding {kind}")
    counted = placed.groupBy("leaf").count().collect()  # one row per leaf, their number set by the sample
    sizes = np.zeros(leaves, dtype=np.int64)
    sizes[[r["leaf"] for r in counted]] = [r["count"] for r in counted]

    asking = rows.where(is_query).dropDuplicates()
    ids, points = some(asking, CALIBRATION, 2)
    if not len(ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    enough = budget(forest, sizes, points, true_neighbours(index, points, ids, k), recall)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in batches:
            kind = rows_.column(1).type
            schema = pa.schema([("part", pa.int32()), ("query_id", pa.int64()), ("vector", kind), ("leaves", pa.list_(pa.int32()))])
            out = []
            for own, one in zip(rows_.column(0).to_pylist(), matrix(rows_.column(1))):
                met, chosen = 0, []
                for leaf in shared.value.walk(one):
                    chosen.append(leaf)
                    met += sizes[leaf]
                    if met >= max(enough, 1):
                        break
                chosen = np.array(chosen, dtype=np.int32)
                out.extend((part, own, one, chosen[chosen % parts == part]) for part in np.unique(chosen % parts))
            if out:
                yield batch(schema, *map(list, zip(*out)))

    def searched(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [] if not left.num_rows or not right.num_rows else search_part(left, right, k)
        tables = [batch(FOUND, [q] * len(ids_), ids_, scores) for q, ids_, scores in found]
        return pa.Table.from_batches(tables, schema=FOUND)

    questions = asking.mapInArrow(opened, f"part int, query_id long, vector {kind}, leaves array<int>")
    index_parts = placed.withColumn("part", F.col("leaf") % parts)
    found = index_parts.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(searched, FOUND_DDL)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
