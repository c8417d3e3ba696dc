"""Token counts by batch encoding, lengths only (operator 3).

Arrow batches go to a SentencePiece model; no token leaves the worker. Texts are
cut at safe boundaries into units of bounded size and the units are encoded in
batches of about equal bytes, so neither a very long text nor a batch of many long
ones needs much memory.

A boundary is safe at a single space between two plain characters: the model's
pieces hold the space mark at their start only, so no merge crosses the cut, and
the mark that the model puts before every unit stands for the space that was cut out.
Plain is what the model's normaliser turns neither into a space nor into nothing, and not the space mark itself: visible ASCII,
and letters and digits of any script. The model is asked for the property of its pieces first; without it texts stay whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, by_bytes, document_text, table
from .registry import query

MODEL = "piece_bpe_32k.model"
UNIT_BYTES = 16_384
BATCH_BYTES = 1 << 18
SPACE_MARK = "▁"

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    """The model, and whether a cut at a single space is safe with it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    apart = all(SPACE_MARK not in piece.lstrip(SPACE_MARK) for piece in pieces)
    prefixed = model.encode("a b", out_type=str)[0].startswith(SPACE_MARK)
    return model, apart and prefixed


def plain(char: str) -> bool:
    if char.isascii():
        return " " < char < "\x7f"
    return unicodedata.normalize("NFKC", char).isalnum()


def safe_cut(text: bytes, at: int) -> bool:
    """Whether the space at a place stands between two plain characters, of up to four bytes each."""
    before = text[max(at - 4, 0) : at].decode("utf-8", "ignore")
    after = text[at + 1 : at + 5].decode("utf-8", "ignore")
    return bool(before and after) and plain(before[-1]) and plain(after[0])


def units(text: bytes, limit: int = UNIT_BYTES) -> Iterator[bytes]:
    """Cut a text at single spaces into units of at most ``limit`` bytes where such spaces exist.

    A stretch without a safe boundary stays whole, so the counts are right for any text.
    """
    start, end = 0, len(text)
    while end - start > limit:
        cut = start + limit
        while True:
            cut = text.rfind(b" ", start + 1, cut)
            if cut < 0 or safe_cut(text, cut):
                break
        if cut < 0:  # no safe boundary below the limit: the next one above it
            cut = text.find(b" ", start + limit)
            while cut >= 0 and not safe_cut(text, cut):
                cut = text.find(b" ", cut + 1)
            if cut < 0:
                break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def count_batch(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each text."""
    model, safe = load(path)
    owners: list[int] = []
    parts: list[bytes] = []
    for at, text in enumerate(texts):
        for unit in units(text) if safe else (text,):
            owners.append(at)
            parts.append(unit)
    counts = [0] * len(texts)
    at = 0
    for run in by_bytes(parts, BATCH_BYTES):
        for ids in model.encode([part.decode("utf-8", "replace") for part in run], num_threads=1):
            counts[owners[at]] += len(ids)
            at += 1
    return counts


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``; one scan, no shuffle."""
    bounded_batches(docs.sparkSession)
    path = path or model_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            yield batch(COUNTS, rows.column(0), [len(t) for t in texts], count_batch(texts, path))

    counted = document_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
