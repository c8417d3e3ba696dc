"""The mix against SQL, and its materialised documents against its plan."""

import math
from collections import Counter, defaultdict

import helpers
from pyspark.sql import functions as F

from ordermill.llm import mixing, queries

def plan_rows(frame):
    return frame.select("doc_id", "source", "size", "source_size", "target", "taken", "times").collect()


def test_query_matches_sql(spark):
    got = mixing.op2_mixing(spark, helpers.SF)
    assert helpers.rows(got.select(*sorted(got.columns))) == helpers.sql_rows(queries.ORACLES["op2_mixing"])


def test_odd_rows(spark):
    docs = helpers.edge(spark)
    got = plan_rows(mixing.mix(docs))
    assert len(got) == len(helpers.EDGE)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(helpers.words(r[1]))) for r in helpers.EDGE)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1e-6
        assert rows[0].target <= 2 * rows[0].source_size + 1e-9
    total = sum(r.size for r in got)
    assert abs(sum(rows[0].target for rows in by_source.values()) - 1.5 * total) < 1e-6 * total


def test_excess_is_shared_by_weight(spark):
    # weights 3, 1, 2 of 150: the first stops at 20, the rest is shared 1 to 2 and the third stops at 60
    rows = [(k, "w " * n, "en", s) for k, (s, n) in enumerate((("a", 10), ("b", 60), ("c", 30)))]
    targets = {r["source"]: r["target"] for r in mixing.mix(helpers.frame(spark, rows)).collect()}
    assert targets == {"a": 20.0, "b": 70.0, "c": 60.0}


def test_documents_of_a_mix_repeat_as_planned(spark):
    docs = helpers.edge(spark)
    plan = mixing.mix(docs).groupBy("doc_id").agg({"times": "sum"}).collect()
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counted = Counter(r["doc_id"] for r in got.collect())
    assert counted == Counter({r[0]: r[1] for r in plan if r[1]})


def test_reruns_agree_and_nothing_stays_nothing(spark):
    docs = helpers.edge(spark)
    assert helpers.rows(mixing.mix(docs)) == helpers.rows(mixing.mix(docs.repartition(3)))
    assert mixing.mix(helpers.none(spark)).count() == 0
    assert mixing.mixed_documents(helpers.none(spark)).count() == 0


def test_quality_raises_the_chance(spark):
    rows = [(k, "w " * 10, "en", "a" if k < 400 else "b") for k in range(800)]
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(800)], "doc_id long, quality int")
    labels = labels.unionByName(spark.createDataFrame([(0, None)], "doc_id long, quality int"))
    got = mixing.mix(helpers.frame(spark, rows), mixing.quality_weights(labels), share=0.5).collect()
    taken = Counter((r.doc_id % 2) for r in got if r.times)
    assert taken[1] > 1.5 * taken[0]


def test_many_equal_rows_are_counted_and_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 300)
    rows = [(1, "one row again", "en", "a")] * 2_000 + [(None, "no id", "en", "a")] * 700 + [(k, f"text {k}", "en", "b") for k in range(2, 900)]
    docs = helpers.frame(spark, rows)
    plan = mixing.mix(docs).groupBy("doc_id").agg({"times": "sum"}).collect()
    got = mixing.mixed_documents(docs)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({r[0]: r[1] for r in plan if r[1]})
    assert {r["text"] for r in got.where("doc_id = 1").collect()} == {"one row again"}
    # no task holds the group
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = mixing.mixed_documents(docs).where("doc_id = 1").rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(n > 0 for n in sizes) > 1


def slow_times(rows, rest):
    """Times beyond whole epochs, row by row in the order of the plan."""
    run, out = 0, []
    for size in rows:
        run += size
        out.append(int(rest > 0 and run - size / 2 <= rest))
    return out


def test_equal_rows_are_taken_as_if_one_by_one(spark):
    cases = [(rest, before, size, n) for rest in (0.0, 0.5, 7.0, 7.5, 10.25, 100.0) for before in (0, 3, 9) for size in (0, 1, 3, 7) for n in (1, 2, 9)]
    frame = spark.createDataFrame(cases, "rest double, before long, size long, n long")
    got = frame.select("*", mixing.copies_within(*(frame[c] for c in frame.columns)).alias("m")).collect()
    for r in got:
        expected = sum(r["rest"] > 0 and r["before"] + (j + 1) * r["size"] - r["size"] / 2 <= r["rest"] for j in range(r["n"]))
        assert r["m"] == expected, r


def test_slices_are_even_whatever_the_keys(spark, monkeypatch):
    """Half of the rows share one id: slices stay short, and the takes are those of one sorted run."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 64)
    rows = [(None, "w " * (k % 90), "en", "a") for k in range(3_000)] + [(k, "w " * (k % 37), "en", "a" if k % 3 else "b") for k in range(3_000)]
    docs = helpers.frame(spark, rows)
    seen = []
    whole = mixing.in_slices

    def counted(frame, order):
        out = whole(frame, order)
        seen.extend(r["count"] for r in out.groupBy("_slice").count().collect())
        return out

    monkeypatch.setattr(mixing, "in_slices", counted)
    got = mixing.mix(docs).collect()
    assert max(seen) <= 64 and len(seen) > 40
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(helpers.words(t))) for i, t, _, s in rows)
    draws = {r[0]: r[1] for r in docs.select("doc_id", mixing.uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).distinct().collect()}
    for source in "ab":
        own = [r for r in got if r.source == source]
        epochs = min(2, int(own[0].target // own[0].source_size))
        order = sorted(own, key=lambda r: (-math.log(draws[r.doc_id]) / 0.5, r.doc_id if r.doc_id is not None else -1, r.size, -r.times))
        slow = slow_times([r.size for r in order], own[0].target - epochs * own[0].source_size)
        assert [r.times - epochs for r in order if r.size] == [t for t, r in zip(slow, order) if r.size]
