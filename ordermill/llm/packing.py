"""Best-fit packing of tokenised documents into training sequences (operator 6).

Documents are encoded once; what is kept of a piece is its place, its length and the
checksum of its ids, in a written table. The pieces are then dealt out evenly over
groups of bounded size, and each group is packed by best-two-fit: a bin is filled with the
longest piece that still fits until none does, then its smallest piece gives way
to the two unpacked pieces that fill the widened gap more tightly, if there are two.
Groups lose at most their last bin each, so their number follows from the piece count.

The tokenizer drops white space and never joins across it, so ids are found word by word
and kept in a memo of bounded size; new words of a batch are encoded in one call and told apart by
the word ends that the vocabulary marks (words of letters) or by a special token put between them.

Defined results: a null or empty text is the one piece that holds the end id alone; rows that share
a doc_id are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batch, bounded_batches, by_bytes, document_text, table, written
from .registry import query

TOKENIZER = "word_bpe_49k.json"
SEPARATOR = "<|endoftext|>"
WORD_END = "</w>"
MARKS = (b".", b",")
END_ID = 1
MAX_TOKENS = 4096
#: Pieces packed together in one task. A group wastes one bin at most, some 20,000 being filled.
GROUP_PIECES = 40_000
#: Words whose ids a worker remembers, and the longest of them in bytes.
MEMO_WORDS = 1_000_000
MEMO_BYTES = 64
CHUNK_BYTES = 1 << 20

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = f"{PIECES_DDL}, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.memo: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> np.ndarray:
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(found, dtype="<u4")

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. A mark after a letter starts a token of its own, so words are encoded without it."""
        found, letters, others, marked = {}, set(), [], []
        for word in missing:
            core = word[:-1] if word[-1:] in MARKS else word
            if len(word) > MEMO_BYTES or b"<|" in word:
                found[word] = self.ids(word).tobytes()
            elif core.decode("utf-8", "replace").lower().isalpha():
                letters.add(core)
                if core is not word:
                    marked.append(word)
            else:
                others.append(word)
        known = self.runs(sorted(letters), b"\n", lambda ids: np.flatnonzero(self.ends_word[ids]) + 1, 0)
        tails = {mark: self.ids(mark).tobytes() for mark in MARKS}
        found.update((word, known[word[:-1]] + tails[word[-1:]]) for word in marked)
        found.update(known)
        between = f"\n{SEPARATOR}\n".encode()
        found.update(self.runs(others, between, lambda ids: np.append(np.flatnonzero(ids == self.separator), len(ids)), 1))
        return found

    def runs(self, words: list[bytes], between: bytes, ends_of, gap: int) -> dict[bytes, bytes]:
        """Encode words by the run: joined, then cut where ``ends_of`` says that one ends, ``gap`` ids apart."""
        found = {}
        for run in by_bytes(words, CHUNK_BYTES):
            ids = self.ids(between.join(run))
            ends = ends_of(ids)
            if len(ends) != len(run):  # not one word end each after all
                found.update((word, self.ids(word).tobytes()) for word in run)
                continue
            starts = np.concatenate(([0], ends[:-1] + gap)).tolist()
            raw = ids.tobytes()
            found.update((word, raw[4 * s : 4 * e]) for word, s, e in zip(run, starts, ends.tolist()))
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for run in by_bytes(texts, CHUNK_BYTES):
            # the tokenizer works in lower case but for its special tokens
            split = [(text if b"<|" in text else text.lower()).split() for text in run]
            missing = set().union(*split).difference(self.memo)
            if len(self.memo) + len(missing) > MEMO_WORDS:
                self.memo = {}
                missing = set().union(*split)
            new = self.learn(missing)
            self.memo.update(new)
            look = self.memo.__getitem__
            for parts in split:
                yield b"".join(map(look, parts))
            for word in new:
                if len(word) > MEMO_BYTES:
                    del self.memo[word]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """Documents as token ids with the end id after them, cut where longer than ``limit``."""
    bounded_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * limit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for doc_id, raw in zip(rows.column(0).to_pylist(), encoder(path).encode(rows.column(1).to_pylist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield batch(PIECES, *map(list, zip(*out)))

    return document_text(docs).mapInArrow(cut, PIECES_DDL)


class Lengths:
    """Unpacked pieces by length: how many of each are left, and the lengths in order."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.order: list[int] = values.tolist()
        self.left: dict[int, int] = dict(zip(self.order, counts.tolist()))

    def take(self, length: int) -> None:
        self.left[length] -= 1
        if not self.left[length]:
            del self.left[length]
            del self.order[bisect_left(self.order, length)]

    def put(self, length: int) -> None:
        if length not in self.left:
            self.order.insert(bisect_left(self.order, length), length)
        self.left[length] = self.left.get(length, 0) + 1

    def longest(self, room: int) -> int:
        """The longest length that fits, or 0."""
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else 0

    def best_two(self, room: int) -> tuple[int, int]:
        """The two lengths with the largest sum that fits, or zeros."""
        short = np.array(self.order[: bisect_left(self.order, room)])
        if not len(short):
            return 0, 0
        at = np.searchsorted(short, room - short, side="right") - 1
        single = (at >= 0) & (short[at] == short) & (np.array([self.left[x] for x in short.tolist()]) < 2)
        at[single] -= 1
        sums = np.where(at >= 0, short + short[at], 0)
        best = int(sums.argmax())
        return (int(short[best]), int(short[at[best]])) if sums[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of lengths, none above ``limit``, that hold every given length once."""
    pool, bins = Lengths(lengths), []
    while pool.order:
        room, held = limit, []
        while room and (length := pool.longest(room)):
            pool.take(length)
            held.append(length)
            room -= length
        if room and len(held) > 1 and pool.order:
            smallest = held[-1]
            one, two = pool.best_two(room + smallest)
            if one + two > smallest:
                held.pop()
                pool.put(smallest)
                for length in (one, two):
                    pool.take(length)
                    held.append(length)
        bins.append(held)
    return bins


def place(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of one length are taken in row order."""
    order = np.argsort(lengths, kind="stable")
    bins = best_two_fit(lengths, limit)
    sizes = np.fromiter((length for held in bins for length in held), dtype=np.int64, count=len(lengths))
    number = np.repeat(np.arange(len(bins)), [len(held) for held in bins])
    ends = np.cumsum(sizes)
    first = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1)) if len(sizes) else np.zeros(0, dtype=int)
    before = np.repeat((ends - sizes)[first], np.diff(np.append(first, len(sizes))))
    slots = np.argsort(sizes, kind="stable")
    bin_of, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bin_of[order], offset[order] = number[slots], (ends - sizes - before)[slots]
    return bin_of, offset


def pack(docs: DataFrame, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """Every piece with the sequence that holds it and its place there."""
    cut = written(pieces(docs, path or tokenizer_path(), limit), "packing-pieces")
    groups = max(1, math.ceil(cut.count() / GROUP_PIECES))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a round-robin deal: a group holds about GROUP_PIECES rows whatever their keys
        rows = pa.Table.from_batches([b for b in batches if b.num_rows], schema=None) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        bin_of, offset = place(rows.column("length").to_numpy(), limit)
        sequence = bin_of + (TaskContext.get().partitionId() << 40)
        yield batch(PLACED, *(rows.column(f.name).combine_chunks() for f in PIECES), sequence, offset)

    return cut.repartition(groups).mapInArrow(packed, PLACED_DDL)


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
