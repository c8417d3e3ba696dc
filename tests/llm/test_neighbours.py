"""Nearest neighbours against brute force."""

import helpers
import numpy as np
import pyarrow.parquet as pq

from ordermill.llm import neighbours

SF1 = f"{helpers.DATA}/sf0.01"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        others = sorted((-float(np.sum(np.array(v, dtype=float) * np.array(vectors[q], dtype=float))), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in others[:k]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, expected):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in e}) / max(1, len(e)) for q, e in expected.items()])


def test_recall_and_scores_on_the_sample(spark):
    table = pq.read_table(f"{SF1}/embeddings.parquet")
    vectors = dict(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    expected = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = answers(neighbours.op7_nearest(spark, SF1))
    assert set(got) == set(expected) and all(len(x) == 20 for x in got.values())
    assert recall(got, expected) >= 0.9
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            assert abs(s - float(np.dot(np.array(vectors[i], dtype=float), np.array(vectors[q], dtype=float)))) < 1e-12


def test_recall_over_many_leaves(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 16))
    points = centres[random.integers(0, 40, 8_000)] + 0.3 * random.normal(size=(8_000, 16))
    vectors = {i: p.tolist() for i, p in enumerate(points)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(frame, neighbours.F.col("vec_id") % 200 == 0, k=10))
    assert recall(got, brute(vectors, range(0, 8_000, 200), 10)) >= 0.9


def test_ties_copies_and_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = {i: [1.0, 0.0, 0.0] for i in range(60)} | {i: [0.0, 1.0, float(i)] for i in range(60, 70)}
    unfit = [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 0.0]), (104, [nan, 1.0, 1.0]),
             (105, [inf, 1.0, 1.0]), (120, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    rows = list(vectors.items()) + unfit + [(20, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "c", "d") for i, v in rows], "vec_id long, embedding array<double>, leaf string, part string")
    got = answers(neighbours.nearest(frame, neighbours.F.col("vec_id") % 20 == 0, k=20))
    expected = brute(vectors, (0, 20, 40, 60), 20)
    assert got == expected
    assert [i for i, _ in got[20]][:20] == [*range(20)]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    assert answers(neighbours.nearest(few, neighbours.F.col("vec_id") % 20 == 0)) == {0: [(1, 5.0), (2, 0.0)]}
    alone = few.where("vec_id = 0")
    assert neighbours.nearest(alone, neighbours.F.col("vec_id") % 20 == 0).count() == 0
    empty = neighbours.nearest(few.where("vec_id > 9"), neighbours.F.col("vec_id") % 20 == 0)
    assert empty.count() == 0 and empty.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
