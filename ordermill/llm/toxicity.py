"""Toxicity by subword-bag embeddings under a linear softmax (operator 9).

A word is the bag of its character n-grams, each hashed to one row of an embedding matrix. The
rows of the words in a window are averaged (a short window is filled up with zeros), and a linear softmax tells toxic from clean; matrix and
softmax are trained jointly, in numpy, on a bounded sample of labelled documents. A misspelt word
that was never seen shares most n-grams with the word it comes from, and so its place.

Labels mark whole documents, of which a few words are toxic. So training goes in rounds: first every
window of a toxic document counts as toxic, then only those that the model picks, at least one. A text is
scored by its worst window; windows overlap and cover all of it. The worst windows of documents held out of
the fit turn that into a probability.

Frozen, a word adds one number to its window, so workers keep a bounded memo of words.

Defined results: a null, empty or blank text has no window and gets the softmax bias alone; repeated rows are
scored each; without both labels the score is the share of toxic labels (0 with none); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, crc32_mod, document_text, filtered, one_text, table
from .registry import query

#: Documents of either label that a model is fitted on, and the longest of them in bytes.
SAMPLE_TOXIC = 1_000
SAMPLE_CLEAN = 5_000
SAMPLE_BYTES = 30_000
#: One document in CALIBRATE of the sample is kept for the last step.
CALIBRATE = 5

NGRAMS = (3, 5)
HASH_BITS = 17
DIMENSIONS = 8
WINDOW = 16
STRIDE = 8
#: Passes over the windows in each round.
EPOCHS = (2, 2, 2)
BATCH_WINDOWS = 512
#: Of the windows of clean documents, one in so many is also shown cut short.
SHORT_EVERY = 4
RATE = 0.3
THRESHOLD = 0.7
MEMO_WORDS = 1_000_000

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram rows of each word, as parallel arrays: place of the word, row of the matrix."""
    marked = [b"<" + word + b">" for word in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.cumsum(sizes)[owner] - np.arange(len(flat))
    rolled = np.zeros(len(flat), dtype=np.uint64)
    owners, rows = [], []
    for n in range(1, NGRAMS[1] + 1):
        have = max(0, len(flat) - n + 1)
        rolled[:have] = rolled[:have] * np.uint64(1_099_511_628_211) + flat[n - 1 :] + np.uint64(1)
        if n >= NGRAMS[0]:
            at = np.flatnonzero(room >= n)
            owners.append(owner[at])
            rows.append((rolled[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(owners), np.concatenate(rows).astype(np.int64)


def plain(text: bytes) -> list[bytes]:
    """Words in lower case, without the marks around them; a word of marks alone stays.

    A word that repeats the one before it is left out: a run of one word says no more than the word.
    """
    found = [word.strip(b".,;:!?\"'()[]") or word for word in text.lower().split()]
    return [word for word, _ in groupby(found)]


def spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words."""
    starts = np.arange(0, max(1, n - STRIDE), STRIDE) if n else np.zeros(0, dtype=np.int64)
    return starts, np.minimum(starts + WINDOW, n)


@dataclass(frozen=True)
class Toxicity:
    """A frozen model: what each n-gram adds, the bias, and the last step's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_values(self, words: list[bytes]) -> np.ndarray:
        owner, rows = subwords(words)
        total = np.bincount(owner, weights=self.weights[rows], minlength=len(words))
        return total / np.bincount(owner, minlength=len(words))

    def margin(self, values: np.ndarray) -> float:
        """The worst window's log odds."""
        starts, ends = spans(len(values))
        if not len(starts):
            return self.bias
        sums = np.concatenate(([0.0], np.cumsum(values)))
        return float((sums[ends] - sums[starts]).max()) / WINDOW + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))

    def scores(self, texts: list[bytes], memo: dict[bytes, float]) -> list[float]:
        """Scores of whole texts; ``memo`` keeps the values of words between calls, MEMO_WORDS at most."""
        split = [plain(t) for t in texts]
        missing = list(set().union(*split).difference(memo))
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = list(set().union(*split))
        if missing:
            memo.update(zip(missing, self.word_values(missing).tolist()))
        look = memo.__getitem__
        return [self.score(self.margin(np.fromiter(map(look, w), np.float64, len(w)))) for w in split]


class _Sample:
    """Training windows as words, and words as n-gram rows, both in compressed rows."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        number: dict[bytes, int] = {}
        self.words, cuts, self.doc = [], [], []
        at = 0
        for i, text in enumerate(texts):
            ids = [number.setdefault(w, len(number)) for w in plain(text)]
            self.words.extend(ids)
            for start in range(0, len(ids), WINDOW):
                end = min(start + WINDOW, len(ids))
                cuts.append((at + start, at + end))
                self.doc.append(i)
                if not labels[i] and start % (SHORT_EVERY * WINDOW) == 0:
                    # short windows must be known to be clean too: without them a text of a word or two is at the mercy of the bias
                    cuts.append((at + start, at + start + 1 + i % (end - start)))
                    self.doc.append(i)
            at += len(ids)
        self.words = np.array(self.words, dtype=np.int64)
        self.cuts = np.array(cuts, dtype=np.int64).reshape(-1, 2)
        self.doc = np.array(self.doc, dtype=np.int64)
        self.label = labels[self.doc]
        owner, rows = subwords(list(number))
        order = np.argsort(owner, kind="stable")
        self.rows = rows[order]
        counts = np.bincount(owner, minlength=len(number))
        self.row_start = np.concatenate(([0], np.cumsum(counts)))

    def gather(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some windows: place of the window, n-gram row, and its share in the average."""
        starts, ends = self.cuts[windows].T
        window, at = ranges(starts, ends)
        word = self.words[at]
        first, last = self.row_start[word], self.row_start[word + 1]
        inner, row_at = ranges(first, last)
        share = 1.0 / (WINDOW * (last - first))
        return window[inner], self.rows[row_at], share[inner]


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of several ranges, each with the place of its range."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Toxicity:
    """Train the matrix and the softmax jointly by Adagrad over windows."""
    labels = np.array(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    order = np.random.default_rng(seed)
    held = np.arange(len(labels)) % CALIBRATE == 0
    if min((labels[~held] == 1).sum(), (labels[~held] == 0).sum()) < 1:
        prior = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Toxicity(np.zeros(1 << HASH_BITS), float(prior), 1.0, 0.0)

    sample = _Sample([t for t, h in zip(texts, held) if not h], labels[~held])
    table_ = order.normal(0, 0.1, (1 << HASH_BITS, DIMENSIONS))
    softmax = order.normal(0, 2.0, (DIMENSIONS, 2))
    bias = np.zeros(2)
    grown = [np.full(x.shape, 1e-6) for x in (table_, softmax, bias)]

    def margins(windows: np.ndarray) -> np.ndarray:
        value = table_ @ (softmax[:, 1] - softmax[:, 0])
        out = np.empty(len(windows))
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            window, row, part_share = sample.gather(part)
            out[at : at + len(part)] = np.bincount(window, weights=value[row] * part_share, minlength=len(part))
        return out + bias[1] - bias[0]

    every = np.arange(len(sample.doc))
    chosen = every
    for epochs in EPOCHS:
        for _ in range(epochs):
            for part in np.array_split(order.permutation(chosen), max(1, len(chosen) // BATCH_WINDOWS)):
                window, row, part_share = sample.gather(part)
                used, at = np.unique(row, return_inverse=True)
                vectors = table_[used]
                mean = np.stack(
                    [np.bincount(window, weights=vectors[at, k] * part_share, minlength=len(part)) for k in range(DIMENSIONS)], axis=1
                )
                logits = mean @ softmax + bias
                logits -= logits.max(axis=1, keepdims=True)
                odds = np.exp(logits)
                error = odds / odds.sum(axis=1, keepdims=True)
                error[np.arange(len(part)), sample.label[part]] -= 1
                back = error @ softmax.T
                down = np.stack(
                    [np.bincount(at, weights=back[window, k] * part_share, minlength=len(used)) for k in range(DIMENSIONS)], axis=1
                )
                for value, slope, total, where in (
                    (table_, down, grown[0], used),
                    (softmax, mean.T @ error / len(part), grown[1], slice(None)),
                    (bias, error.mean(axis=0), grown[2], slice(None)),
                ):
                    total[where] += slope * slope
                    value[where] -= RATE * slope / np.sqrt(total[where])
        # of a toxic document, the windows that the model picks, and the worst in any case
        scored = margins(every)
        worst = np.full(sample.doc.max() + 1, -np.inf)
        np.maximum.at(worst, sample.doc, scored)
        chosen = every[(sample.label == 0) | (scored >= np.minimum(worst[sample.doc], 0))]

    raw = Toxicity(table_ @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)
    kept = [(raw.margin(raw.word_values(w)) if (w := plain(t)) else raw.bias) for t, h in zip(texts, held) if h]
    slope, shift = logistic(np.array(kept), labels[held])
    return Toxicity(raw.weights, raw.bias, slope, shift)


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic curve through the margins, by Newton steps with a small prior."""
    if len(np.unique(label)) < 2:
        return 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - label) + 0.05 * (w - (1.0, 0.0))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(max(w[0], 1e-3)), float(w[1])


def training_sample(docs: DataFrame, labels: DataFrame, allowed) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts: of either label, the ids that come first by a hash, one text of each."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    parts = [
        known.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        for label, limit in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    fair = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = one_text(document_text(fair).join(ids, "doc_id"), "_toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [bytes(r["text"]) for r in rows], [int(r["_toxic"]) for r in rows]


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row; one scan, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for rows in batches:
            yield batch(SCORES, rows.column(0), shared.value.scores(rows.column(1).to_pylist(), memo))

    out = document_text(docs).mapInArrow(scored, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows that the model does not predict as toxic, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    memo: dict[bytes, float] = {}  # a task's own, kept from batch to batch

    def clean(texts: pa.Array) -> list[bool]:
        return [s < THRESHOLD for s in shared.value.scores(texts.to_pylist(), memo)]

    return filtered(docs, clean, F.coalesce("text", F.lit("")).cast("binary"))


def fitted(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """The model of the registered query: labels of two thirds of the ids."""
    return fit(*training_sample(docs, labels, crc32_mod("doc_id", 3) != 1))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
