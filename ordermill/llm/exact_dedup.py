r"""Exact duplicates by content hash, with the bytes compared inside groups (operator 11).

Texts are equal when they are identical after every run of ASCII white space became one
space. One pass over the texts writes a compact row per document (id, 128-bit hash,
SHA-256, a row tag), and counting and choosing work on these alone:

* counts per hash are combined on the map side, so a text with any number of copies sends
  one row per task;
* texts whose hash occurs once need no comparison. A second pass groups the others by
  (hash, bytes), again combined on the map side: a task sends each different text once, never its
  copies. Where the repeated hashes are few enough (counted first), they are broadcast and
  the pass reads on only with rows that hold one; otherwise every text is grouped, which
  gives the same classes.

A class of equal bytes is labelled by its hash and SHA-256, and documents find their class by
that label. Texts that share the hash but not the bytes fall into different classes; should
two classes ever share both digests, the job stops instead of merging them.

Defined results: a null text counts as empty, and empty texts are equal to each other; a text
of white space only is one space, another text than the empty one. The row with the smallest doc_id stays,
a null id last; of rows that share text and doc_id exactly one stays, the first in the order of
the written table. A group without any id has a null keep_id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, table, whole_rows, written
from .registry import query

#: So many hashes of 16 bytes are broadcast at most, some tens of MB as a hash table.
BROADCAST_HASHES = 500_000

LABEL = ["_hash", "_sha"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def md5_hash(text: Column) -> Column:
    """128 bits of content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def hashed(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_hash, *more: Column) -> DataFrame:
    """One compact row per document, written: ``_id``, ``_hash``, ``_sha``, ``_tag`` and further columns."""
    text = docs.select(F.col("doc_id").alias("_id"), normalised(F.col("text")).alias("_text"), *more)
    kept = [c for c in text.columns if c != "_text"]
    return written(
        text.select(
            *kept,
            content_hash(F.col("_text")).alias("_hash"),
            F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"),
            F.monotonically_increasing_id().alias("_tag"),
        ),
        "content-hashes",
    )


def byte_classes(
    docs: DataFrame, repeated: DataFrame, content_hash: Callable[[Column], Column], broadcast_hashes: int
) -> DataFrame:
    """``_hash`` and ``_sha`` of each class of equal bytes among texts of repeated hashes."""
    texts = docs.select(normalised(F.col("text")).alias("_text")).select("_text", content_hash(F.col("_text")).alias("_hash"))
    if repeated.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        texts = texts.join(F.broadcast(repeated), "_hash", "left_semi")
    classes = texts.groupBy("_hash", "_text").agg(F.count("*").alias("_rows"))
    return classes.select("_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), "_rows")


def verified_groups(
    docs: DataFrame,
    rows: DataFrame,
    content_hash: Callable[[Column], Column] = md5_hash,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """One row per class with more than one document: its label, ``_keep`` (id and tag of the row that stays), ``_size``."""
    counts = written(rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "repeated-hashes")
    classes = byte_classes(docs, counts, content_hash, broadcast_hashes).groupBy(LABEL).agg(
        F.count("*").alias("_texts"), F.sum("_rows").alias("_rows")
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("missing"), F.col("_id").alias("id"), F.col("_tag").alias("tag")))
    members = rows.groupBy(LABEL).agg(first.alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    apart = F.raise_error(F.lit("different texts share both digests"))
    size = F.when((F.col("_texts") == 1) & (F.col("_rows") == F.col("_size")), F.col("_size")).otherwise(apart.cast("long"))
    # Written, so that the join with the rows stands on two plain shuffles, which may be split at a hot label.
    return written(members.join(classes, LABEL).select(*LABEL, "_keep", size.alias("_size")), "copy-groups")


def decided(
    docs: DataFrame,
    *more: Column,
    content_hash: Callable[[Column], Column] = md5_hash,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and the hash of its text."""
    rows = hashed(docs, content_hash, *more)
    groups = verified_groups(docs, rows, content_hash, broadcast_hashes)
    alone = F.col("_size").isNull()
    return rows.join(groups, LABEL, "left").select(
        *[c for c in rows.columns if c not in ("_id", "_tag", *LABEL)],
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_tag") == F.col("_keep.tag"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, whole and with the columns of the table."""
    whole = whole_rows(docs).select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    return decided(whole, F.col("_row")).where("kept").select("_row.*")


SQL = r"""
select doc_id, first_value(doc_id) over same as keep_id, count(*) over (partition by content) as group_size,
       row_number() over same = 1 as kept, sha256(content) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
window same as (partition by content order by doc_id nulls last rows between unbounded preceding and unbounded following)
"""


@query(SQL)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(table(spark, sf_dir, "documents"))
