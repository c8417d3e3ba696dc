"""Language identification by prediction by partial matching (operator 8).

Each language has a byte context tree, its order varying up to three: the chance of a byte
after a context that was seen with it is its share there, and otherwise the escape probability of the context
times the chance after the next shorter context (method C, without exclusions). The statistics are
frozen, so the exact code length of a text is a sum over its bytes of a function of the byte and the
three before it. That function is tabulated, and texts are scored whole, by array look-ups.

Texts are taken in lower case; every ASCII byte other than a letter counts as one gap symbol.
Counts come from a bounded sample per language of distinct pieces of texts (a text up to the length of a piece is one), summed by Spark;
of a long text any piece may be drawn.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned;
equal code lengths go to the language first in code-point order; repeated rows are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, crc32_mod, filtered, table
from .registry import query

#: Expected pieces of texts per language in the sample that is learned from, and the longest of them in characters.
SAMPLE_PIECES = 1_500
PIECE_CHARACTERS = 20_000
UNDETERMINED = "und"
#: A text counts as at most so many independent bytes when code lengths become a score.
EVIDENCE_BYTES = 64
#: Below this score the pipeline rejects a document: no language stands out.
LEAST_SCORE = 0.35

#: Symbols: the gap, a-z, and each byte of multi-byte characters.
SYMBOLS = 1 + 26 + 128


def _symbol_table() -> np.ndarray:
    symbols = np.zeros(256, dtype=np.uint8)
    symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
    symbols[128:] = np.arange(27, SYMBOLS)
    return symbols


SYMBOL = _symbol_table()


def grams(text: bytes) -> np.ndarray:
    """Per byte, its symbol and the three before it in base SYMBOLS; the text starts after gaps."""
    s = np.concatenate((np.zeros(3, dtype=np.int64), SYMBOL[np.frombuffer(text, np.uint8)].astype(np.int64)))
    return ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]


@dataclass(frozen=True)
class ContextTrees:
    """Counts of byte 4-grams by language, from which all shorter contexts follow."""

    languages: list[str]
    grams: np.ndarray
    counts: np.ndarray  # grams x languages
    _tables: list = field(default_factory=list, compare=False)

    def tables(self) -> tuple:
        """Code lengths in bits, built once per process; all languages side by side.

        ``short``: of a byte after its two predecessors, by the row that ``pair`` has for these.
        ``leave``: of the escape from a context of three bytes, by the row that ``triple`` has, nothing for a new context.
        ``slots``, ``keys`` and ``deep``: a hash table of the 4-grams that were seen, with their code lengths.
        """
        if not self._tables:
            self._tables.append(self._build())
        return self._tables[0]

    def _build(self) -> tuple:
        base, width = SYMBOLS, len(self.languages)
        probability = np.full((1, base, width), 1.0 / base)  # before any byte: all symbols alike
        for order in range(3):
            lower, probability = probability, self._refine(probability, self.grams % base ** (order + 1), order)
        seen = np.unique(self.grams % base**3 // base)
        pair = len(seen) + np.arange(base**2, dtype=np.int32) % base
        pair[seen] = np.arange(len(seen))
        short = -np.log2(np.concatenate((probability[seen], lower))).astype(np.float32)

        contexts, of = np.unique(self.grams // base, return_inverse=True)
        triple = np.zeros(base**3, dtype=np.int32)
        triple[contexts] = np.arange(1, len(contexts) + 1)
        leave = np.zeros((len(contexts) + 1, width), dtype=np.float32)
        deep = np.zeros((len(self.grams) + 1, width), dtype=np.float32)
        for k in range(width):
            count = self.counts[:, k]
            n = np.bincount(of, weights=count, minlength=len(contexts))
            d = np.bincount(of, weights=count > 0, minlength=len(contexts))
            met = n > 0
            leave[1:, k][met] = -np.log2(d[met] / (n[met] + d[met]))
            fallback = leave[1 + of, k] + short[pair[self.grams % base**3 // base], self.grams % base, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                known = -np.log2(count / (n + d)[of])
            deep[1:, k] = np.where(count > 0, known, fallback)

        bits = max(12, int(4 * len(self.grams) + 1).bit_length())
        slots = np.zeros(1 << bits, dtype=np.int32)
        waiting, number, probes = self.grams, np.arange(1, len(self.grams) + 1, dtype=np.int32), 0
        while len(waiting):  # open addressing: whoever keeps a slot stays, the others try the next
            at = slot(waiting, probes, bits)
            free = slots[at] == 0
            slots[at[free]] = number[free]
            lost = slots[at] != number
            waiting, number, probes = waiting[lost], number[lost], probes + 1
        return pair, short, triple, leave, slots, np.concatenate(([-1], self.grams)), deep, bits, probes

    def _refine(self, lower: np.ndarray, part: np.ndarray, order: int) -> np.ndarray:
        """Probabilities after ``order`` bytes from those after one byte fewer."""
        base, width = SYMBOLS, len(self.languages)
        out = np.empty((base**order, base, width), dtype=np.float32)
        for k in range(width):
            c = np.bincount(part, weights=self.counts[:, k], minlength=base ** (order + 1)).reshape(-1, base)
            n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            below = np.tile(lower[:, :, k], (len(c) // len(lower), 1)) if order else lower[:, :, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[:, :, k] = np.where(n == 0, below, np.where(c > 0, c / (n + d), d / (n + d) * below))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        pair, short, triple, leave, slots, keys, deep, bits, probes = self.tables()
        base = SYMBOLS
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            for at in range(0, len(text), 1 << 20):  # very long texts part by part, three bytes of context carried over
                lead = min(at, 3)
                codes = grams(text[at - lead : at + (1 << 20)])[lead:]
                found = np.zeros(len(codes), dtype=np.int32)
                open_ = np.arange(len(codes))
                for probe in range(probes):
                    entry = slots[slot(codes[open_], probe, bits)]
                    hit = keys[entry] == codes[open_]
                    found[open_[hit]] = entry[hit]
                    open_ = open_[~hit & (entry > 0)]
                    if not len(open_):
                        break
                new = codes[found == 0]
                out[i] += deep[found].sum(axis=0, dtype=np.float64)  # entry 0 is empty and adds nothing
                out[i] += leave[triple[new // base]].sum(axis=0, dtype=np.float64)
                out[i] += short[pair[new // base % base**2], new % base].sum(axis=0, dtype=np.float64)
        return out


    def predictions(self, texts: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of lower-case texts, given which of them hold a letter."""
        if not self.languages or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        raw = texts.to_pylist()
        fair = letters.to_numpy(zero_copy_only=False).astype(bool)
        bits = self.code_lengths(raw)
        best = bits.argmin(axis=1)
        evidence = np.minimum(1.0, EVIDENCE_BYTES / np.maximum(1, [len(t) for t in raw]))
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * evidence[:, None])
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, fair)]
        return names, np.where(fair, odds.max(axis=1) / odds.sum(axis=1), 0.0)


def slot(codes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
    return (mixed.astype(np.int64) + probe) & ((1 << bits) - 1)


def lower_text() -> Column:
    return F.lower(F.coalesce("text", F.lit(""))).cast("binary")


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def labelled_pieces(docs: DataFrame, allowed) -> DataFrame:
    """``lang`` and ``text`` of every piece of the texts that may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    cut = F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % PIECE_CHARACTERS), F.lit(0))
    whole = F.octet_length("text") <= PIECE_CHARACTERS
    return known.select("lang", F.explode(F.when(whole, F.array("text")).otherwise(cut)).alias("text"))


def learn(docs: DataFrame, allowed) -> ContextTrees:
    """Count byte 4-grams per language over a hash sample of about SAMPLE_PIECES distinct pieces each."""
    bounded_batches(docs.sparkSession)
    pieces = labelled_pieces(docs, allowed)
    sizes = pieces.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("count"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    languages = sorted((r["lang"], r["count"]) for r in sizes.collect())
    share = F.lit(0.0)
    for name, count in languages:
        share = F.when(F.col("lang") == name, F.lit(SAMPLE_PIECES / count)).otherwise(share)
    # equal pieces have one draw and are learned once
    sample = pieces.where(draw < share).distinct().select("lang", lower_text().alias("text"))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = np.array(rows.column(0).to_pylist(), dtype=object)
            texts = rows.column(1).to_pylist()
            for name in sorted(set(names.tolist())):
                codes = [grams(t) for t, own in zip(texts, names) if own == name]
                values, n = np.unique(np.concatenate(codes), return_counts=True)
                yield batch(schema, [name] * len(values), values, n)

    counted = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    names = sorted(found["lang"].unique().tolist())
    codes, row = np.unique(found["gram"].to_numpy(dtype=np.int64), return_inverse=True)
    counts = np.zeros((len(codes), len(names)))
    counts[row, [names.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    return ContextTrees(names, codes, counts)


def identify(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row; one scan, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, rows.column(0), *shared.value.predictions(*rows.columns[1:3]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_text().alias("text"), has_letter().alias("letters"))
    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: ContextTrees, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of which the language can be told, with all their columns: neither ``und`` nor below the least score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def told(texts: pa.Array, letters: pa.Array) -> list[bool]:
        names, scores = shared.value.predictions(texts, letters)
        return [name != UNDETERMINED and score >= least for name, score in zip(names, scores)]

    return filtered(docs, told, lower_text(), has_letter())


def learned(docs: DataFrame) -> ContextTrees:
    """The model of the registered query: three quarters of the ids."""
    return learn(docs, crc32_mod("doc_id", 4) != 2)


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
