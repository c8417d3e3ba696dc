r"""Ranked lexical search by an Aho-Corasick scan of the documents (operator 13).

All different terms of the items form one automaton, which is broadcast; there is no index of
the documents. A scan lower-cases A-Z in a text, turns everything that no term can hold into a guard
character, puts one at either end, and runs the automaton over it. Its words are guarded terms, so only
whole terms match, and the counts of its outputs are the term frequencies. Two scans are made:

1. document frequencies, number and length of the documents, added up per task and then by Spark;
2. scores: outputs lead to the items that hold the term, contributions are added per (document, item) for one
   Arrow batch at a time, and a task keeps the best documents of each item only. These lists are merged in two
   rounds, by item and group of tasks, then by item.

The automaton is bounded: items are dealt to blocks of at most ``BLOCK_BYTES`` of terms and ``BLOCK_ITEMS`` items
(one larger item is a block of its own), and the documents are scanned once more for each block.

Defined results: a null or empty text has no terms and is never ranked; an item without terms has no rows; items that share an item_id
are ranked each; documents that share a doc_id too. A null doc_id is after all others of its score.
An empty table of either kind gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, bounded_batches, document_text, table, written
from .registry import query

#: What a term cannot hold: all of ASCII but letters and digits.
GUARD = " "
_ASCII = bytes(c if chr(c).isalnum() else ord(GUARD) for c in range(128)).lower()
FOLDED = _ASCII + bytes(range(128, 256))

#: Bounds of one automaton.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 1_024
BEST = 50
#: Tasks whose lists meet in one group of the first merge.
TASK_GROUP = 256
LAST_ID = (1 << 63) - 1

RANKED = pa.schema([("item", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def guarded(text: bytes) -> bytes:
    """The terms of a text with guards between them, at the start and at the end."""
    return b" %s " % text.translate(FOLDED)


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


@dataclass(frozen=True)
class Block:
    """Items and their different terms: ``items[starts[t]:starts[t + 1]]`` are the places of those that hold term ``t``."""

    numbers: np.ndarray
    terms: list[str]
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, held: list[tuple[int, set[str]]]) -> "Block":
        found = sorted(set().union(*(own for _, own in held)))
        place = {term: at for at, term in enumerate(found)}
        pairs = sorted((place[term], at) for at, (_, own) in enumerate(held) for term in own)
        starts = np.searchsorted([t for t, _ in pairs], np.arange(len(found) + 1))
        return cls(np.array([n for n, _ in held]), found, starts, np.array([i for _, i in pairs], dtype=np.int64))


def blocks(items: Iterable[tuple[int, bytes]], limit: int = BLOCK_BYTES, most: int = BLOCK_ITEMS) -> Iterator[Block]:
    """Deal numbered items out; an item without terms is left out."""
    held: list[tuple[int, set[str]]] = []
    size = 0
    for number, text in items:
        own = {term.decode("utf-8", "replace") for term in terms(text)}
        if not own:
            continue
        more = sum(len(term.encode()) for term in own)
        if held and (size + more > limit or len(held) == most):
            yield Block.of(held)
            held, size = [], 0
        held.append((number, own))
        size += more
    if held:
        yield Block.of(held)


@lru_cache(maxsize=1)
def automaton(shared: Broadcast):
    """The block's automaton, built once per worker; its outputs are term numbers."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, term in enumerate(shared.value.terms):
        found.add_word(f"{GUARD}{term}{GUARD}", number)
    found.make_automaton()
    return found


def frequencies(words, text: bytes) -> Counter:
    return Counter(map(itemgetter(1), words.iter(guarded(text).decode("utf-8", "replace"))))


def statistics(texts: DataFrame, shared: Broadcast, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the document frequency of each of the block's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(shared)
        seen = np.zeros(n_terms + 2, dtype=np.int64)
        for part in batches:
            for text in part.column(1).to_pylist():
                if n := len(terms(text)):
                    seen[0] += 1
                    seen[1] += n
                    seen[2 + np.fromiter(frequencies(words, text), dtype=np.int64)] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found - 2), pa.array(seen[found])], names=["term", "n"])

    parts = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = np.zeros(n_terms + 2, dtype=np.int64)
    for term, n in parts.collect():  # one row per term of the block
        totals[term + 2] = n
    return int(totals[0]), int(totals[1]), totals[2:]


class Leaders:
    """The best documents of each item, as far as one task has seen them."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]  # heaps of (score, -id), worst first
        self.bar = np.zeros(n_items, dtype=np.int64)  # a score below cannot enter

    def add(self, ids: list[int], scores: np.ndarray) -> None:
        """Scores as one row per document and one column per item."""
        for row, item in zip(*np.nonzero((scores >= self.bar) & (scores > 0))):
            heap, one = self.held[item], (int(scores[row, item]), -ids[row])
            if len(heap) < self.best:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)
            if len(heap) == self.best:
                self.bar[item] = heap[0][0]


def leaders(texts: DataFrame, shared: Broadcast, totals: tuple[int, int, np.ndarray], best: int) -> DataFrame:
    """The best documents of each item in each task: ``item``, ``part``, ``doc_id`` and ``score``."""
    n_docs, length, frequency = totals
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, block = automaton(shared), shared.value
        n_items = len(block.numbers)
        found = Leaders(n_items, best)
        for part in batches:
            ids, size, owner, term, tf = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts = frequencies(words, text)
                if counts:
                    owner += [len(ids)] * len(counts)
                    term += counts.keys()
                    tf += counts.values()
                    ids.append(LAST_ID if doc_id is None else doc_id)
                    size.append(len(terms(text)))
            if not ids:
                continue
            owner, term, tf = (np.array(x, dtype=np.int64) for x in (owner, term, tf))
            m = 50 + (50 * np.array(size, dtype=np.int64) * n_docs) // length
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            scores = np.zeros(len(ids) * n_items, dtype=np.int64)
            spread = block.starts[term + 1] - block.starts[term]
            first = np.repeat(block.starts[term] - (np.cumsum(spread) - spread), spread)
            item = block.items[first + np.arange(spread.sum())]
            np.add.at(scores, np.repeat(owner, spread) * n_items + item, np.repeat(share, spread))
            found.add(ids, scores.reshape(len(ids), n_items))
        task = TaskContext.get().partitionId()
        for at, heap in enumerate(found.held):
            if heap:
                ids = [None if -i == LAST_ID else -i for _, i in heap]
                yield batch(RANKED, [int(block.numbers[at])] * len(heap), [task] * len(heap), ids, [s for s, _ in heap])

    return texts.mapInArrow(rank, "item long, part long, doc_id long, score long")


def merged(lists: DataFrame, best: int) -> DataFrame:
    """The best of all tasks, in two rounds."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = Window.partitionBy("item", F.floor(F.col("part") / TASK_GROUP)).orderBy(*order)
    some = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, limit: int = BLOCK_BYTES, most: int = BLOCK_ITEMS
) -> DataFrame:
    """The ``best`` documents of each item: ``item_id``, ``rank``, ``doc_id`` and ``score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = document_text(docs)
    numbered = written(
        items.select(
            F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")
        ),
        "items",
    )
    found = None
    for block in blocks(((r.item, bytes(r.text)) for r in numbered.select("item", "text").toLocalIterator()), limit, most):
        shared = spark.sparkContext.broadcast(block)
        totals = statistics(texts, shared, len(block.terms))
        if totals[0] == 0:
            break
        some = written(merged(leaders(texts, shared, totals, best), best), "ranked")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "item long, part long, doc_id long, score long, rank int")
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
with found as (
    select row_number() over () as doc, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents where text is not null
), counted as (
    select doc, doc_id, len(terms)::bigint as n, unnest(terms) as term from found where len(terms) > 0
), totals as (
    select count(distinct doc)::bigint as n_docs, count(*)::bigint as length from counted
), asked as (
    select item, item_id, unnest(list_distinct(terms)) as term from (
        select row_number() over () as item, item_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from benchmark where text is not null)
), tf as (
    select doc, doc_id, n, term, count(*)::bigint as tf from counted where term in (select term from asked) group by all
), weight as (
    select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, totals group by term, n_docs
), shares as (
    select doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))) as share
    from tf join weight using (term), totals
), scored as (
    select item, item_id, doc, doc_id, sum(share)::bigint as score from shares join asked using (term) group by all
)
select item_id, rank, doc_id, score from (
    select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
where rank <= 50
"""


@query(SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
