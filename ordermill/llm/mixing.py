"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2).

Every document draws an exponential key, scaled by its quality weight: the smallest keys of a source
are a weighted sample without replacement. A source whose target is
above its size gives whole epochs first; the rest of its target is filled in key order, up
to the document whose middle the budget passes, so the sum ends within half a document of it.

Prefix sums take two levels: all rows are sorted by source and key over range partitions and cut into slices of SLICE_ROWS rows;
sums per slice are added up first, then rows within a slice. No task sees a whole source, however large, and no slice
holds more than another, whatever the keys. Rows that agree in all that the plan looks at are one row with their number, so a
third of all rows may share one id and size. The draw is a digest of doc_id, so reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an
unlabelled document has the middle weight; rows that share a doc_id are drawn each (equal key, ordered
by size); a source without words has target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import digest, table, whole_rows, words, written
from .registry import query

#: Source weights in code-point order, repeating; the share of all sizes that the mix holds; the most epochs.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
#: Weight by label quality; documents without a label have the middle one.
QUALITY_WEIGHT = {1: 1.0, 0: 0.25}
UNLABELLED = 0.5
#: Equal rows that one task writes out.
PIECE_ROWS = 10_000
#: Rows of a slice. The sums of a source's slices meet in one task: 10^10 rows are some 10^6 of them.
SLICE_ROWS = 1 << 12


def uniform(key: Column) -> Column:
    """A draw in (0, 1) from 52 bits of a digest."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """One weight per labelled document; the best of repeated labels."""
    weight = F.when(F.max("quality") >= 1, F.lit(QUALITY_WEIGHT[1])).otherwise(F.lit(QUALITY_WEIGHT[0]))
    return labels.where("quality is not null").groupBy("doc_id").agg(weight.alias("_weight"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """One row per source: its size, target, whole epochs and the rest.

    Targets are min(epochs * size, level * weight): with sources in order of size by weight, the level is
    found from running sums over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_w", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.lit(float(epochs)) * F.col("source_size")
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    upward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = ranked.select(
        "*",
        (
            (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
            / F.sum("_w").over(upward)
        ).alias("_level"),
    )
    # the first source in this order that the level leaves below its cap, and all after it, are not capped
    open_level = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level")))
    level = open_level.over(Window.partitionBy())["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least("_cap", level * F.col("_w")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0)
    return (
        levelled.withColumn("target", target)
        .withColumn("epochs", whole.cast("long"))
        .select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    )


def in_slices(frame: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The frame with ``_slice``: runs of at most SLICE_ROWS rows, numbered along the order, which must be a total one."""
    ordered = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts the rows of a partition from a multiple of 2^33, so no slice spans two partitions
    return ordered.withColumn("_slice", F.floor(F.monotonically_increasing_id() / SLICE_ROWS))


def copies_within(rest: Column, before: Column, size: Column, count: Column) -> Column:
    """How many of ``count`` equal rows, the first of which starts at ``before``, have their middle within the rest."""

    def fits(number: Column) -> Column:
        return before + number * size - size / 2 <= rest

    near = F.floor((rest - before) / size + 0.5)  # off by one at most, for rounding
    number = F.when(fits(near + 1), near + 1).when(fits(near), near).otherwise(near - 1)
    some = F.when(size > 0, F.greatest(F.lit(0), F.least(count, number))).when(before <= rest, count).otherwise(0)
    return F.when(rest > 0, some).otherwise(0).cast("long")


def planned(docs: DataFrame, quality: DataFrame | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The plan by groups of rows equal in id, source, size and ``keep``: their number ``_rows``, whole ``epochs``, and how many get one ``_more``."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *keep)
    if quality is not None:
        sized = sized.join(quality, "doc_id", "left")
    else:
        sized = sized.withColumn("_weight", F.lit(None).cast("double"))
    draw = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = draw / F.coalesce("_weight", F.lit(UNLABELLED))
    order = ("source", "_key", "doc_id", "size", *keep)
    equal = written(sized.withColumn("_key", key).groupBy(*order).agg(F.count("*").alias("_rows")), "mixing-sizes")
    keyed = written(in_slices(equal, order), "mixing-slices")

    words_of = (F.col("size") * F.col("_rows")).alias("size")
    targets = source_targets(equal.select("source", words_of), **options)
    sums = keyed.select("source", "_slice", words_of).groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_source"),
        F.col("_slice").alias("_in"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    targets = targets.withColumnRenamed("source", "_of")
    starts = starts.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")

    rows = keyed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_in")))
    within = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_rows")).over(within), F.lit(0))
    placed = rows.withColumn("_ahead", ahead)
    more = copies_within(F.col("rest"), F.col("_ahead"), F.col("size"), F.col("_rows"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "_rows", "epochs", more.alias("_more"), *keep)


def mix(docs: DataFrame, quality: DataFrame | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The plan of a mix: per document its size, its source's size and target, and ``times`` and words taken.

    ``quality`` holds (doc_id, _weight); ``keep`` names further columns to carry along.
    """
    groups = planned(docs, quality, keep, **options)
    pieces = groups.withColumn("_piece", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_rows") / PIECE_ROWS))))
    upto = F.least(F.col("_rows"), F.col("_piece") * PIECE_ROWS)
    rows = pieces.withColumn("_copy", F.explode(F.sequence((F.col("_piece") - 1) * PIECE_ROWS + 1, upto)))
    times = F.col("epochs") + (F.col("_copy") <= F.col("_more")).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), *keep
    )


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The documents of a mix: each row as often as the mix takes it, with the columns of ``docs``.

    Rows meet the plan by doc_id and a digest of the row. Equal rows are one row with the sum of their takes, dealt
    out in pieces, as many as there are equal rows for: no task gets more of them than PIECE_ROWS.
    """
    tagged = docs.select("doc_id", "source", "text", digest(docs).alias("_tag"))
    plan = planned(tagged, quality, keep=("_tag",), **options)
    piece = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_rows") / PIECE_ROWS).cast("int"))).alias("_piece")
    times = F.sum(F.col("epochs") * F.col("_rows") + F.col("_more"))
    sums = plan.groupBy(F.col("doc_id").alias("_id"), "_tag").agg(times.alias("_sum"), F.sum("_rows").alias("_rows"))
    pieces = F.ceil(F.col("_rows") / PIECE_ROWS)
    parts = sums.where("_sum > 0").select("_id", "_tag", "_sum", pieces.alias("_pieces"), piece)
    until = [F.floor(F.col("_sum") * upto / F.col("_pieces")) for upto in (F.col("_piece"), F.col("_piece") - 1)]
    takes = parts.select("_id", "_tag", F.col("_piece").alias("_part"), (until[0] - until[1]).cast("int").alias("_times"))

    rows = whole_rows(docs, F.col("doc_id").alias("_own"), digest(docs).alias("_digest"))
    single = rows.groupBy("_own", "_digest").agg(F.first("_row").alias("_row"), F.count("*").alias("_rows"))
    single = single.select("_own", "_digest", "_row", piece)
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_tag")) & (F.col("_piece") == F.col("_part"))
    # a broadcast would leave all pieces of a row where the row is
    taken = single.join(takes.where("_times > 0").hint("merge"), same)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


SQL = r"""
with recursive sized as (
    select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           case when q.best >= 1 then 1.0 when q.best is not null then 0.25 else 0.5 end::double as weight
    from documents d left join (select doc_id, max(quality) as best from labels where quality is not null group by 1) q
        on q.doc_id = d.doc_id
), keyed as (
    select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0) / weight as k
    from sized
), totals as (
    select source, sum(size)::double as s, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
    from sized group by source
), filling as (
    select 0 as round, source, s, w, false as capped, 0.0::double as target from totals
    union all
    select round + 1, source, s, w, capped or level * w >= 2 * s,
           case when capped or level * w >= 2 * s then 2 * s else level * w end
    from (select *, (1.5 * sum(s) over () - coalesce(sum(2 * s) filter (where capped) over (), 0))
                    / nullif(sum(w) filter (where not capped) over (), 0) as level
          from filling)
    where round < (select count(*) from totals)
), targets as (
    select source, s, target, case when s > 0 then least(floor(target / s), 2) else 0 end as epochs
    from filling where round = (select count(*) from totals)
), run as (
    select k.doc_id, k.size, t.s, t.target, t.epochs, t.target - t.epochs * t.s as rest,
           sum(k.size) over (partition by k.source order by k.k, k.doc_id, k.size rows unbounded preceding) as upto
    from keyed k join targets t on k.source is not distinct from t.source
)
select doc_id, size, s::bigint as source_size, target,
       ((epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end) * size)::bigint as taken
from run
"""


@query(SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
