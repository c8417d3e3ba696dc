"""SimHash near-duplicates found through vantage-point trees (operator 1).

Fingerprints: each bit is the majority of that bit over the XXH64 hashes of a text's word shingles.

Pairs: the bits are cut into blocks. Two fingerprints within the radius are within
``radius // blocks`` in some block, and distances within a block are a metric of their own, narrow enough for triangle bounds
to cut (over all 64 bits random fingerprints lie so close to 32 from each other that a radius of 4 prunes next to nothing).
For each block a vantage-point tree, grown on a bounded sample, parts *all* fingerprints by their
distance to its vantage points into leaves, the shards. A fingerprint lives in one leaf and visits every further
leaf that the triangle bounds cannot rule out. Within a shard residents are compared with residents and visitors, exactly
and on all bits, block of rows by block of rows.

Groups: a shard emits a spanning forest of its links, never its pairs, so thousands of copies
cost as many rows. Components over all shards come from alternating large-star and small-star
steps, written between rounds; the edges of a node with a large share of them are spread over salted cells.

Only distinct fingerprints are compared, so exact copies are one entry however many there are. Many fingerprints may share the bits of a block,
and no tree over that block can part them. Such a shard is cut into stripes, and every pair of stripes is a cell of its own: a task
holds one cell, whatever the size of the shard. The comparisons within such a shard still grow with the square of its distinct fingerprints.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of fewer words than
a shingle is one shingle; repeated rows each get a row; a null doc_id never names a component (a component
of null ids alone has a null id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, bounded_batches, digest, document_text, table, whole_rows, written
from .registry import query

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 3
#: Fingerprints that trees are grown on, fingerprints a leaf should hold, and leaves per tree at most.
SAMPLE = 30_000
LEAF = 1_024
MAX_LEAVES = 1 << 16
COMPARE_ROWS = 256
#: Rows of a shard that are compared in one task; a longer shard is cut into stripes of about as many.
STRIPE_ROWS = 1 << 14
#: A node with more than one of so many parts of all edges has its edges spread; there are fewer than twice as many such nodes.
HUBS = 1 << 12

LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The text's SimHash, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    shingles = max(1, len(words) - size + 1)
    first = starts[:shingles].tolist()
    last = (starts + lengths)[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, shingles, 1 << 16):
        part = zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            set_bits += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    majority = np.packbits(2 * set_bits > shingles, bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprints(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """``doc_id``, ``fp``, the fingerprint as a signed long, and a long of the caller's."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("tag", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = np.array([fingerprint(t) for t in rows.column(1).to_pylist()], dtype=np.uint64)
            yield batch(schema, rows.column(0), found.view(np.int64), rows.column(2))

    tagged = docs.select("doc_id", "text", (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    return document_text(tagged, "tag").mapInArrow(hashed, "doc_id long, fp long, tag long")


@dataclass(frozen=True)
class VantageTree:
    """A tree over one block of bits. A node holds a vantage point and a distance; nearer points go left.

    ``child`` is the number of a node, or of a leaf as its complement.
    """

    mask: np.uint64
    point: np.ndarray
    distance: np.ndarray
    child: np.ndarray  # nodes x (left, right)

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every value's own leaf, and the leaves after it that may hold values within ``reach``.

        Returns places of values, leaves, and whether the leaf is the value's own. Of two values in different leaves that
        are within reach, the one in the earlier leaf visits the other.
        """
        at = np.arange(len(values))
        node = np.zeros(len(values), dtype=np.int64)
        own = np.ones(len(values), dtype=bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(self.point):
            return at, node, own
        while len(at):
            d = np.bitwise_count((values[at] ^ self.point[node]) & self.mask).astype(np.int64)
            mu = self.distance[node]
            go_left, go_right = d - reach <= mu, d + reach > mu
            home_left = d <= mu
            # leaves are numbered from left to right: a value already to the left of its home has no business there
            go_left &= ~own | home_left
            steps = [
                (at[go], self.child[node[go], side], own[go] & (home_left[go] == (side == 0)))
                for side, go in ((0, go_left), (1, go_right))
            ]
            at, node, own = (np.concatenate(x) for x in zip(*steps))
            leaf = node < 0
            done.append((at[leaf], ~node[leaf], own[leaf]))
            at, node, own = at[~leaf], node[~leaf], own[~leaf]
        return tuple(np.concatenate(x) for x in zip(*done))


def grow(sample: np.ndarray, mask: int, depth: int, seed: int = 11) -> VantageTree:
    """A tree of at most ``depth`` levels; a node splits its part of the sample at the median distance."""
    random = np.random.default_rng(seed)
    mask = np.uint64(mask)
    points, distances, children, leaves = [], [], [], 0

    def build(part: np.ndarray, level: int) -> int:
        nonlocal leaves
        if level < depth and len(part) > 1:
            best = None
            for vantage in part[random.integers(0, len(part), 4)]:  # of a few, the one that splits most evenly
                d = np.bitwise_count((part ^ vantage) & mask)
                mu = int(np.median(d))
                mu -= (d <= mu).all()
                balance = abs(int((d <= mu).sum()) * 2 - len(part))
                if mu >= 0 and (best is None or balance < best[0]):
                    best = balance, vantage, mu, d <= mu
            if best is not None:
                _, vantage, mu, near = best
                number = len(points)
                points.append(vantage)
                distances.append(mu)
                children.append([0, 0])
                children[number][0] = build(part[near], level + 1)
                children[number][1] = build(part[~near], level + 1)
                return number
        leaves += 1
        return ~(leaves - 1)

    build(sample, 0)
    return VantageTree(
        mask,
        np.array(points, dtype=np.uint64),
        np.array(distances, dtype=np.int64),
        np.array(children, dtype=np.int64).reshape(-1, 2),
    )


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; every entry of ``parent`` ends at the smallest place of its set."""
    while True:
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])


def shard_links(home: np.ndarray, other: np.ndarray, radius: int, inner: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root), of the links between ``home`` and ``other`` and, if ``inner``, within ``home``."""
    everyone = np.concatenate((np.sort(home), other))
    parent = np.arange(len(everyone))
    for at in range(0, len(home), COMPARE_ROWS):
        rows = everyone[at : min(at + COMPARE_ROWS, len(home)), None]
        for start in range(at if inner else len(home), len(everyone), 1 << 16):
            near = np.bitwise_count(rows ^ everyone[None, start : start + (1 << 16)]) <= radius
            a, b = np.nonzero(near)
            forest(parent, a + at, b + start)
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return everyone[member], everyone[parent[member]]


def cell_links(values: np.ndarray, own: np.ndarray, first: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of one cell: within its only stripe, or between the rows of its ``first`` stripe and those of the other."""
    if first.all():
        return shard_links(values[own], values[~own], radius)
    parts = (
        shard_links(values[first & own], values[~first], radius, inner=False),
        shard_links(values[~first & own], values[first & ~own], radius, inner=False),
    )
    return tuple(np.concatenate(x) for x in zip(*parts))


def cells(shards: DataFrame) -> DataFrame:
    """Rows of shards (``shard``, ``fp``, ``home``) by cell: the pair of stripes ``low`` and ``high``, and whether the row is of the low one."""
    sizes = shards.groupBy("shard").count().where(F.col("count") > STRIPE_ROWS)
    stripes = F.ceil(F.col("count") / STRIPE_ROWS).cast("int")
    long = F.broadcast(sizes.select(F.col("shard").alias("_long"), stripes.alias("_stripes")))  # at most BLOCKS * MAX_LEAVES rows
    known = shards.join(long, F.col("shard") == F.col("_long"), "left").withColumn("_stripes", F.coalesce("_stripes", F.lit(1)))
    striped = known.withColumn("_stripe", F.pmod(F.xxhash64("fp"), "_stripes").cast("int"))
    met = striped.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1)))
    low = F.least("_stripe", "_met")
    return met.select("shard", low.alias("low"), F.greatest("_stripe", "_met").alias("high"), "fp", "home", (F.col("_stripe") == low).alias("first"))


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that have the components of all pairs within ``radius``."""
    spark = distinct.sparkSession
    count = distinct.count()
    draw = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, count)) * (1 << 30)))
    sample = np.sort(np.array([r["fp"] for r in distinct.where(draw).select("fp").collect()], dtype=np.int64)).view(np.uint64)
    depth = math.ceil(math.log2(min(MAX_LEAVES, max(1, count / LEAF))))
    trees = spark.sparkContext.broadcast([grow(sample, mask, depth) for mask in block_masks(blocks)])
    reach = radius // blocks
    routed_schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = rows.column(0).to_numpy().view(np.uint64)
            for block, tree in enumerate(trees.value):
                at, leaf, own = tree.route(values, reach)
                yield batch(routed_schema, leaf * blocks + block, values[at].view(np.int64), own)

    def linked(group: pa.Table) -> pa.Table:
        values = group.column("fp").to_numpy().view(np.uint64)
        own, first = (group.column(name).to_numpy() for name in ("home", "first"))
        u, v = cell_links(values, own, first, radius)
        return pa.Table.from_batches([batch(LINKS, u.view(np.int64), v.view(np.int64))], schema=LINKS)

    shards = written(distinct.select("fp").mapInArrow(routed, "shard long, fp long, home boolean"), "simhash-shards")
    return cells(shards).groupBy("shard", "low", "high").applyInArrow(linked, "u long, v long").distinct()


def beside_least(pairs: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Every pair (u, v) with ``m``, the least neighbour of u; ``least`` also holds the number ``d`` of u's pairs, ``edges`` is a share's whole.

    A hub's pairs are dealt over cells by v, and its row of ``least`` is repeated once per cell.
    """
    parts = F.ceil(F.col("d") * HUBS / F.lit(edges)).cast("int")
    hubs = F.broadcast(least.where(parts > 1).select(F.col("u").alias("_hub"), parts.alias("_parts")))  # at most 2 * HUBS rows
    part = F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = pairs.join(hubs, F.col("u") == F.col("_hub"), "left").select("u", "v", part.alias("_part"))
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")), ["u", "_part"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge but the roots: large-star and small-star until nothing changes."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not state[0] or tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = beside_least(both.where("v > u"), least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = beside_least(large, least, state[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small, "links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tag: Column | None = None) -> DataFrame:
    """Every row with its ``fp``, its group's ``root`` fingerprint, its ``component_id`` (the smallest doc_id of the group) and its tag."""
    hashed = written(fingerprints(docs, tag), "simhash")
    distinct = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return hashed.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: of the smallest doc_id, the row with the least digest."""
    found = near_duplicates(docs, radius, digest(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag"))
    chosen = found.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_tag"))
    rows = whole_rows(docs, F.col("doc_id").alias("_own"), digest(docs).alias("_digest"))
    kept = rows.join(chosen, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_tag")))
    place = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("_digest"))  # equal rows: one
    return kept.withColumn("_place", place).where("_place = 1").select("_row.*")


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
