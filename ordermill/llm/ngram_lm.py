"""Language-model scores from an Elias-Fano n-gram trie (operator 10).

The model is a trigram model over all training words and the end of a text:

    P(word | two before) = interpolated absolute discounting over P3, P2, P1

P3 and P2 subtract a fixed discount from seen counts and give it to the next lower order; P1 adds one to each count. Every
order grows with the corpus: every training word, pair and triple of words is counted, stored and looked up.

Each place of a text (two marks before it and its end included) begins a path of three words. A shard holds a trie of paths:
all that begin with the words dealt to it by hash. Words that begin very many paths (``LowerOrders``; counted by Spark, few
whatever the corpus) are dealt out by their second word, and their very frequent pairs by the third, so no shard holds
more of one word than it may. What several shards know of such a context adds up.

One pass over the texts sends each shard, per block of documents, its distinct paths, once each, with training counts. The
shard adds up the counts, builds its trie, and answers each block with the counts of its words, pairs and triples. The block's
own tokens go through one of the shards, another for each block, and meet the answers in the block's group, where documents are scored.

The trie of a shard: words, pairs and triples, each an Elias-Fano sequence with monotone pointers into the next one, in a
memory-mapped temporary file without a name. A follower w of the node at place i is stored as i times the shard's number of words,
plus w, and found by a successor search. A node's number of followers is the difference of its pointers.

Words are known by a 64-bit hash. Rows are told apart by their place in a block, so repeated rows and null ids
are scored each.

Defined results: a null or empty text is the end token alone; a word not seen in training has count 0; with nothing to learn from
the end and an unseen word are equally likely, the base is 0, and so is n_known; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, crc32_mod, table
from .eliasfano import EliasFano, MappedFile
from .registry import query

#: Numbers of contexts that are split over shards: none, the start (also the end, which nothing follows), the begin, then hot words.
#: Not a limit on words of the model; a corpus of CLASSES * HOT_TOKENS tokens would use them all.
CLASSES = 1 << 20
TAIL, END, BEGIN, FIRST_HEAD = range(4)
DISCOUNT = 0.75
#: Tokens of a block of documents, and tokens whose paths a shard receives.
BLOCK_TOKENS = 1 << 21
BLOCK_DOCUMENTS = 60_000
SHARD_TOKENS = 4_000_000
#: A context seen this often in training is split over the shards.
HOT_TOKENS = SHARD_TOKENS // 16
#: Bits of a word's hash that decide on its shard.
TAG_BITS = 24
#: What stands before a text (twice, told apart) and after it; no word has a blank in it.
MARKS = np.array([xxhash.xxh64_intdigest(mark) for mark in (b" start", b" begin", b" end")], dtype=np.uint64)


#: Bytes of text hashed at once. A word hash is a polynomial over random values of its bytes, upper case taken as lower.
CHUNK_BYTES = 1 << 16
ODD = 0x9E3779B97F4A7C15
_RANDOM = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], dtype=np.uint64)
_GAP = np.array([bytes([b]).isspace() for b in range(256)])  # of bytes: the six of ASCII
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """``base`` to the powers from 0, modulo 2^64, for a chunk or as many as are asked for."""
    size = max(size, CHUNK_BYTES + 1)
    if size > CHUNK_BYTES + 1 or base not in _POWERS:
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        found = np.cumprod(steps)
        if size > CHUNK_BYTES + 1:
            return found
        _POWERS[base] = found
    return _POWERS[base]


def word_spans(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of a buffer begin and end; a word ends where a text does. ``first``: where texts begin."""
    word = ~_GAP[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[first] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def chunks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words within a chunk of bytes, or one longer word."""
    at = 0
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + CHUNK_BYTES, side="right")))
        yield at, upto
        at = upto


def hashed_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer of texts in order, and how many there are before each text and in all."""
    begins, ends = word_spans(data, first)
    out = np.empty(len(begins), dtype=np.uint64)
    for a, b in chunks(data, begins, ends):
        low, high = int(begins[a]), int(ends[b - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[data[low:high]] * powers(ODD, high - low)[: high - low], out=sums[1:])
        start, end = begins[a:b] - low, ends[a:b] - low
        out[a:b] = (sums[end] - sums[start]) * powers(pow(ODD, -1, 1 << 64), high - low)[start]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out, np.append(np.searchsorted(begins, first), len(begins))


def word_hashes(text: bytes) -> np.ndarray:
    return hashed_words(np.frombuffer(text, dtype=np.uint8), np.zeros(1, dtype=np.int64))[0]


def found_in(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked in sorted values, and whether they are there."""
    at = np.searchsorted(values, asked)
    seen = at < len(values)
    seen[seen] = values[at[seen]] == asked[seen]
    return np.where(seen, at, 0), seen


@dataclass(frozen=True)
class LowerOrders:
    """What every task knows: training totals, and the contexts that are split over shards with their counts."""

    heads: np.ndarray  # sorted hashes of hot words and marks
    head_class: np.ndarray
    head_count: np.ndarray
    tokens: int
    types: int
    ends: int
    pairs: np.ndarray  # sorted keys v * CLASSES + w of hot pairs
    pair_count: np.ndarray

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        at, seen = found_in(self.heads, hashes)
        return np.where(seen, self.head_class[at], TAIL)

    def pair_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        by_class = self.heads[np.argsort(self.head_class)]  # classes are numbered from END without a gap
        return by_class[self.pairs // CLASSES - END], by_class[self.pairs % CLASSES - END]


def lower_orders(heads: list[tuple[int, int]], tokens: int, types: int, ends: int, pairs: np.ndarray, counts: np.ndarray) -> LowerOrders:
    """``heads``: (hash, count) of the hot words; ``pairs``: sorted keys of pairs of classes with their training counts."""
    if FIRST_HEAD + len(heads) > CLASSES:  # their pairs would no longer have keys of their own
        raise ValueError(f"more than {CLASSES - FIRST_HEAD} words begin {HOT_TOKENS} paths: raise SHARD_TOKENS")
    hashes = np.concatenate((MARKS[:2], np.array([h for h, _ in heads], dtype=np.int64).view(np.uint64)))
    number = np.concatenate(([END, BEGIN], np.arange(FIRST_HEAD, FIRST_HEAD + len(heads))))
    count = np.concatenate(([ends, ends], np.array([n for _, n in heads], dtype=np.int64)))
    order = np.argsort(hashes)
    words = (pairs // CLASSES >= BEGIN) & (pairs % CLASSES >= FIRST_HEAD)
    keys = np.concatenate(([END * CLASSES + BEGIN], pairs[words])).astype(np.int64)
    seen = np.concatenate(([ends], counts[words])).astype(np.int64)
    return LowerOrders(hashes[order], number[order], count[order], tokens, types, ends, keys, seen)


class Paths:
    """Distinct words, pairs and triples that begin at the places of a block's texts, and the shards of the triples."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, tags: np.ndarray, split: tuple, lower: LowerOrders, shards: int):
        """``words``: of all texts, as places in the sorted vocabulary, which holds the marks too; ``tags``: the first
        bits of the vocabulary's hashes; ``split``: places of the marks, of hot words and marks, and where these stand in ``lower``."""
        (start, begin, end), self.hot_word, self.hot_word_is = split
        first = np.cumsum(sizes + 5) - (sizes + 5)
        padded = np.full(len(words) + 5 * len(sizes), end, dtype=np.int64)
        padded[first], padded[first + 1] = start, begin
        padded[np.arange(len(words)) + np.repeat(5 * np.arange(len(sizes)) + 2, sizes)] = words
        starts = np.ones(len(padded), dtype=bool)
        starts[first + sizes + 3] = starts[first + sizes + 4] = False
        at = np.flatnonzero(starts)
        self.word_at = padded[at]
        pairs, self.pair_at = np.unique(padded[at] * len(tags) + padded[at + 1], return_inverse=True)
        triples, self.triple_at = np.unique(self.pair_at * len(tags) + padded[at + 2], return_inverse=True)
        self.pair_first, self.pair_second = pairs // len(tags), pairs % len(tags)
        self.pair_of, self.third = triples // len(tags), triples % len(tags)

        number = np.zeros(len(tags), dtype=np.int64)
        number[self.hot_word] = lower.head_class[self.hot_word_is]
        place, hot = found_in(lower.pairs, number[self.pair_first] * CLASSES + number[self.pair_second])
        self.hot_pair = np.flatnonzero(hot)
        self.hot_pair_is = place[self.hot_pair]
        pair_key = tags[self.pair_first]
        parted = number[self.pair_first] != TAIL
        pair_key[parted] = mixed(pair_key[parted]) ^ tags[self.pair_second[parted]]
        key = pair_key[self.pair_of]
        parted = np.flatnonzero(hot[self.pair_of])
        key[parted] = mixed(key[parted]) ^ tags[self.third[parted]]
        shard = spread(key, shards)
        order = np.argsort(narrow(shard), kind="stable")  # short numbers are sorted by their digits
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        self.parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def nodes(self, shard: int) -> tuple[np.ndarray, ...]:
        """Words, pairs, and triples of a shard, and where the first pair of each word and the first triple of each pair stand."""
        triples = self.parts[shard]
        pair = self.pair_of[triples]
        triple_start = runs(pair)
        pairs = pair[triple_start]
        pair_start = runs(self.pair_first[pairs])
        return self.pair_first[pairs[pair_start]], pairs, triples, pair_start, triple_start


class ShardTrie:
    """The trie of one shard's training paths; words are numbers below ``kinds``."""

    def __init__(self, paths: np.ndarray, pairs: np.ndarray, counts: np.ndarray, kinds: int):
        """``paths``: sorted place-in-``pairs`` * kinds + word; ``pairs``: sorted word * kinds + word; counts above zero."""
        used, of = np.unique(paths // kinds, return_inverse=True)
        pairs = pairs[used]
        words, word_of = np.unique(pairs // kinds, return_inverse=True)
        store = MappedFile()
        self.kinds = kinds
        self.words = EliasFano(words, store)
        self.word_starts = EliasFano(np.append(runs(word_of), len(pairs)), store)
        self.pairs = EliasFano(word_of * kinds + pairs % kinds, store)
        self.pair_starts = EliasFano(np.append(runs(of), len(paths)), store)
        self.triples = EliasFano(of * kinds + paths % kinds, store)
        totals = np.bincount(of, weights=counts, minlength=len(pairs)).astype(np.int64)
        self.triple_count = store.put(narrow(counts))
        self.pair_count = store.put(narrow(totals))
        self.word_count = store.put(narrow(np.bincount(word_of, weights=totals, minlength=len(words)).astype(np.int64)))

    @staticmethod
    def _values(place: np.ndarray, known: np.ndarray, counts: np.ndarray, starts: EliasFano | None) -> tuple[np.ndarray, ...]:
        out = np.zeros((2 if starts else 1, len(place)), dtype=np.int64)
        met = np.flatnonzero(known)
        out[0, met] = counts[place[met]]
        if starts:
            out[1, met] = starts.access(place[met] + 1).astype(np.int64) - starts.access(place[met]).astype(np.int64)
        return tuple(out)

    def _follow(self, level: EliasFano, place: np.ndarray, known: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes that ``word`` leads to from the nodes at ``place``, and whether they are there."""
        out, seen = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=bool)
        met = np.flatnonzero(known)
        out[met], seen[met] = level.successor(place[met] * np.int64(self.kinds) + word[met])
        return out, seen

    def look_up(self, words: np.ndarray, pair_of: np.ndarray, seconds: np.ndarray, triple_of: np.ndarray, thirds: np.ndarray) -> list[np.ndarray]:
        """Counts and numbers of followers of words and of pairs, and counts of triples; pairs name their word's place among
        ``words``, triples that of their pair."""
        place, known = self.words.successor(words)
        out = [*self._values(place, known, self.word_count, self.word_starts)]
        place, known = self._follow(self.pairs, place[pair_of], known[pair_of], seconds)
        out += self._values(place, known, self.pair_count, self.pair_starts)
        place, known = self._follow(self.triples, place[triple_of], known[triple_of], thirds)
        return [*out, *self._values(place, known, self.triple_count, None)]


def split_documents(rows: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, train, hashes of the words) of each row; columns doc_id, text, train."""
    texts = rows.column(1)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, dtype=np.uint8)
    hashes, cuts = hashed_words(held, at[:-1] - at[0])
    for k, (doc_id, train) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())):
        yield doc_id, train, hashes[cuts[k] : cuts[k + 1]]


def sequences(classes: list[np.ndarray]) -> np.ndarray:
    """(u, v, w) keys of every token of some documents, ends included, in order."""
    padded = np.concatenate([part for c in classes for part in ((BEGIN, BEGIN), c, (END,))]).astype(np.int64)
    sizes = np.array([len(c) + 3 for c in classes])
    token = np.ones(len(padded), dtype=bool)
    start = np.cumsum(sizes) - sizes
    token[start] = token[start + 1] = False
    at = np.flatnonzero(token)
    return (padded[at - 2] * CLASSES + padded[at - 1]) * CLASSES + padded[at]


def summed(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    values, of = np.unique(keys, return_inverse=True)
    return values, np.bincount(of, weights=weight, minlength=len(values)).astype(np.int64)


def training_texts(docs: DataFrame, train) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select("doc_id", text, F.coalesce(train, F.lit(True)).alias("train"))


def count_keys(texts: DataFrame, keys_of) -> DataFrame:
    """Training counts of 64-bit keys: summed in tasks per block of tokens, then by Spark."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            for _, _, hashes in split_documents(rows):
                held.append(hashes)
                size += len(hashes) + 1
                if size >= BLOCK_TOKENS:
                    yield batch(schema, *summed(keys_of(held)))
                    held, size = [], 0
        if held:
            yield batch(schema, *summed(keys_of(held)))

    rows = texts.where("train").mapInArrow(counted, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def learn_lower(texts: DataFrame) -> LowerOrders:
    """Totals of all training texts, and the words and pairs that are too frequent for one shard."""
    ends = texts.where("train").count()
    counts = count_keys(texts, lambda held: np.concatenate(held).view(np.int64))
    often = F.collect_list(F.when(F.col("n") >= HOT_TOKENS, F.struct("key", "n"))).alias("heads")  # bounded: all tokens / HOT_TOKENS
    size = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), often).first()
    heads = sorted((r["key"], r["n"]) for r in size["heads"])
    none = np.zeros(0, dtype=np.int64)
    totals = (int(size["tokens"]) + ends, int(size["types"]) + (ends > 0), ends)
    lower = lower_orders(heads, *totals, none, none)
    if not heads:
        return lower
    first = texts.sparkSession.sparkContext.broadcast(lower)

    def pairs_of(held: list[np.ndarray]) -> np.ndarray:
        keys = sequences([first.value.classes(h) for h in held]) % CLASSES**2
        return keys[(keys // CLASSES >= BEGIN) & (keys % CLASSES >= FIRST_HEAD)]

    found = count_keys(texts, pairs_of).where(F.col("n") >= HOT_TOKENS).toPandas().sort_values("key")  # bounded likewise
    return lower_orders(heads, *totals, found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the fewest bytes."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Numbers byte by byte, lowest bytes first: bytes of equal weight side by side compress well."""
    values = narrow(values)
    return values.itemsize, np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)


def unplaned(coded: tuple[int, np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(coded[1].T).view(f"u{coded[0]}").ravel()


def steps(values: np.ndarray) -> tuple[int, np.ndarray]:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def stepped(coded: tuple[int, np.ndarray]) -> np.ndarray:
    return np.cumsum(unplaned(coded), dtype=np.uint64)


def ranked(values: np.ndarray, kinds: int) -> tuple:
    """Numbers below ``kinds`` as ranks by frequency, and the frequencies."""
    counts = np.bincount(values, minlength=kinds)
    rank = np.empty(kinds, dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(kinds)
    return planes(counts), planes(rank[values])


def unranked(coded: tuple) -> np.ndarray:
    counts = unplaned(coded[0]).astype(np.int64)
    return np.argsort(-counts, kind="stable").astype(np.int32)[unplaned(coded[1])]


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def spread(values: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(values) >> np.uint64(31)) % np.uint64(shards)).astype(np.int64)


SUMS = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
SUMS_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
MESSAGE = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("message", pa.binary())])
MESSAGE_DDL = "shard int, block long, message binary"


def message(*content) -> bytes:
    packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return packer.compress(pickle.dumps(content)) + packer.flush()


def opened(messages: pa.ChunkedArray) -> Iterator[tuple]:
    for value in messages:
        yield pickle.loads(zlib.decompress(value.as_py()))


def block(documents: list[tuple], lower: LowerOrders, shards: int, home: int = 0) -> list[bytes]:
    """What one block of (doc_id, train, hashes) sends to each shard.

    The shard ``home`` passes on what is needed to score the documents.
    """
    ids, trains, hashes = zip(*documents)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    train = np.array(trains, dtype=bool)
    vocabulary, of = np.unique(np.concatenate((MARKS, *hashes)), return_inverse=True)
    words = of[len(MARKS) :]
    tags = vocabulary >> np.uint64(64 - TAG_BITS)
    place, hot = found_in(lower.heads, vocabulary)
    split = (np.searchsorted(vocabulary, MARKS), np.flatnonzero(hot), place[hot])
    meta = (list(ids), train, narrow(sizes), ranked(words, len(vocabulary)), steps(tags), split, lower)
    paths = Paths(words, sizes, tags, split, lower, shards)
    counts = np.bincount(paths.triple_at, weights=np.repeat(train, sizes + 3), minlength=len(paths.third)).astype(np.int64)
    out = []
    for k in range(shards):
        firsts, pairs, triples, pair_start, triple_start = paths.nodes(k)
        seconds, thirds = paths.pair_second[pairs], paths.third[triples]
        here, at = np.unique(np.concatenate((firsts, seconds, thirds)), return_inverse=True)
        pair_kinds, triple_kinds = np.diff(np.append(pair_start, len(pairs))), np.diff(np.append(triple_start, len(triples)))
        refs = (steps(at[: len(firsts)]), ranked(at[len(firsts) :], len(here)))
        part = (steps(vocabulary[here]), *refs, *map(planes, (pair_kinds, triple_kinds, counts[triples])))
        out.append(message(k, shards, meta if k == home else None, part))
    return out


def answer(asked: list[tuple], lower: LowerOrders) -> Iterator[tuple]:
    """For each block's message to one shard: training counts and numbers of followers of its words and pairs, counts of its
    triples, and the followers that this shard knows of every context split over shards."""
    tables = [stepped(part[0]) for *_, part in asked]
    vocabulary, of = np.unique(np.concatenate((*tables, lower.heads)), return_inverse=True)
    *numbers, heads = np.split(of.astype(np.int32), np.cumsum([len(t) for t in tables]))
    del tables, of
    kinds = len(vocabulary)
    nodes, seen, about = [], [], []
    while asked:
        k, shards, meta, (_, firsts, others, pair_kinds, triple_kinds, here) = asked.pop()
        number = numbers.pop()
        firsts, others = number[stepped(firsts)], number[unranked(others)]
        pair_of = np.repeat(np.arange(len(firsts), dtype=np.int32), unplaned(pair_kinds))
        triple_of = np.repeat(np.arange(len(pair_of), dtype=np.int32), unplaned(triple_kinds))
        nodes.append((firsts, pair_of, others[: len(pair_of)], triple_of, others[len(pair_of) :]))
        seen.append(unplaned(here))
        about.append((k, shards, meta))
    pairs, pair_is = np.unique(np.concatenate([n[0][n[1]].astype(np.int64) * kinds + n[2] for n in nodes]), return_inverse=True)
    pair_is = np.split(pair_is, np.cumsum([len(n[1]) for n in nodes])[:-1])
    paths, path_is = np.unique(np.concatenate([here[n[3]] * kinds + n[4] for here, n in zip(pair_is, nodes)]), return_inverse=True)
    counts = np.bincount(path_is, weights=np.concatenate(seen), minlength=len(paths)).astype(np.int64)
    del path_is, pair_is, seen
    trie = ShardTrie(paths[counts > 0], pairs, counts[counts > 0], kinds)
    del paths, pairs, counts

    # contexts split over shards: of a word, pairs that are split themselves are counted by the block, once for all shards
    first, second = (np.searchsorted(vocabulary, h) for h in lower.pair_hashes())
    one = np.arange(len(first))
    _, _, pair_count, pair_kinds, _ = trie.look_up(first, one, second, one[:0], one[:0])
    word_kinds = trie.look_up(heads, one[:0], one[:0], one[:0], one[:0])[1]
    np.subtract.at(word_kinds, np.searchsorted(vocabulary[heads], vocabulary[first]), pair_count > 0)
    for known, here in zip(reversed(about), reversed(nodes)):
        yield *known, [planes(v) for v in trie.look_up(*here)], narrow(word_kinds), narrow(pair_kinds)


def combined(answers: list[tuple]) -> tuple:
    """Columns of SUMS for one block, from the answers of all shards."""
    answers = sorted(answers, key=lambda a: a[0])
    shards = answers[0][1]
    ids, train, sizes, words, tags, split, lower = next(a[2] for a in answers if a[2])
    sizes, tags = sizes.astype(np.int64), stepped(tags)
    paths = Paths(unranked(words), sizes, tags, split, lower, shards)
    word, pair = np.zeros((2, len(tags)), dtype=np.int64), np.zeros((2, len(paths.pair_first)), dtype=np.int64)
    triple = np.zeros(len(paths.third), dtype=np.int64)
    word_kinds, pair_kinds = np.zeros(len(lower.heads), dtype=np.int64), np.zeros(len(lower.pairs), dtype=np.int64)
    for k, _, _, values, *more in answers:
        firsts, pairs, triples, *_ = paths.nodes(k)
        word[0, firsts], word[1, firsts], pair[0, pairs], pair[1, pairs], triple[triples] = map(unplaned, values)
        word_kinds += more[0]
        pair_kinds += more[1]
    np.add.at(word_kinds, np.searchsorted(lower.heads, lower.pair_hashes()[0]), lower.pair_count > 0)
    word[0, paths.hot_word], word[1, paths.hot_word] = lower.head_count[paths.hot_word_is], word_kinds[paths.hot_word_is]
    pair[0, paths.hot_pair], pair[1, paths.hot_pair] = lower.pair_count[paths.hot_pair_is], pair_kinds[paths.hot_pair_is]

    # a text of n words begins n + 3 paths; that of its token j begins at j, its pair at j + 1, itself at j + 2
    document = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(document)) + 2 * document
    count = word[0, paths.word_at[at + 2]]
    p = (count + 1) / (lower.tokens + 2 + lower.types - (lower.ends > 0))
    for seen, (total, kinds) in ((pair[0, paths.pair_at[at + 1]], word[:, paths.word_at[at + 1]]), (triple[paths.triple_at[at]], pair[:, paths.pair_at[at]])):
        p = np.where(total > 0, (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)

    def per_document(values):
        return np.bincount(document, weights=values, minlength=len(sizes))

    base = np.log10((count + 1) / (lower.tokens + lower.types + 1))
    return ids, ~train, sizes + 1, per_document(count > 0).astype(np.int64), per_document(base), per_document(np.log10(p))


def score(docs: DataFrame, train) -> DataFrame:
    """Every row's token counts, base score and model score; ``train`` says which rows are learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = training_texts(docs, train)
    model = learn_lower(texts)
    lower = spark.sparkContext.broadcast(model)
    shards = max(1, math.ceil(model.tokens / SHARD_TOKENS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            return batch(MESSAGE, range(shards), [number] * shards, block(held, lower.value, shards, (number ^ number >> 32) % shards))

        for rows in batches:
            for document in split_documents(rows):
                held.append(document)
                size += len(document[2]) + 1
                if size >= BLOCK_TOKENS or len(held) >= BLOCK_DOCUMENTS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    def answered(group: pa.Table) -> pa.Table:
        found = [message(*columns) for columns in answer(list(opened(group.column("message"))), lower.value)]
        return pa.table([pa.nulls(len(found), pa.int32()), group.column("block"), pa.array(found, pa.binary())], schema=MESSAGE)

    def gathered(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch(SUMS, *combined(list(opened(group.column("message")))))], schema=SUMS)

    messages = texts.mapInArrow(sent, MESSAGE_DDL)
    answers = messages.groupBy("shard").applyInArrow(answered, MESSAGE_DDL)
    sums = answers.groupBy("block").applyInArrow(gathered, SUMS_DDL)
    tokens = F.lit(model.tokens).cast("long").alias("train_tokens")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", tokens, "base_score", "score")


@query()
def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 7) != 2)
