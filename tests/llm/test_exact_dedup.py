"""Exact duplicates against plain grouping, with weak hashes that make texts collide."""

import hashlib
import re

import helpers
import pytest
from pyspark.sql import functions as F

from ordermill.llm import exact_dedup

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, keep_id, group size, kept, digest) of each row."""
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(GAP.sub(" ", text or ""), []).append(doc_id)
    found = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, ids[0], len(ids), at == 0, digest) for at, i in enumerate(ids)]
    return sorted(found, key=repr)


MORE = [
    (20, "", None, None),
    (21, "\t", "en", "a"),
    (22, "One  word", "en", "b"),
    (22, "One word", "de", "b"),
    (None, "One\nword", "en", "b"),
    (None, "only without id", "en", "b"),
    (None, "only  without id", "en", "b"),
    (4, "one word", "en", "b"),
    (23, " One word", "en", "b"),
]


def result(frame):
    return helpers.rows(frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def test_edge_rows(spark):
    rows = helpers.EDGE + MORE
    assert result(exact_dedup.decided(helpers.frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("broadcast_hashes", [0, 1_000])
def test_colliding_hashes_are_parted_by_their_bytes(spark, broadcast_hashes):
    rows = helpers.EDGE + MORE

    def by_length(text):
        return F.length(text).cast("string").cast("binary")

    found = exact_dedup.decided(helpers.frame(spark, rows), content_hash=by_length, broadcast_hashes=broadcast_hashes)
    assert result(found) == brute(rows)


def test_texts_that_share_both_digests_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("00"))
    rows = [(1, "ab", None, None), (2, "cd", None, None), (3, "cd", None, None)]
    with pytest.raises(Exception, match="different texts share both digests"):
        exact_dedup.decided(helpers.frame(spark, rows), content_hash=lambda t: F.length(t).cast("string").cast("binary"))


def test_a_group_that_holds_most_rows(spark):
    rows = [(i, "the  same text" if i % 3 else f"text {i}", None, None) for i in range(3_000)]
    assert result(exact_dedup.decided(helpers.frame(spark, rows))) == brute(rows)


def test_rows_stay_whole(spark):
    docs = helpers.frame(spark, helpers.EDGE + MORE)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in brute(helpers.EDGE + MORE))
    assert set(helpers.rows(kept)) <= set(helpers.rows(docs))


def test_no_documents(spark):
    assert exact_dedup.decided(helpers.none(spark)).count() == 0
    assert exact_dedup.without_copies(helpers.none(spark)).count() == 0


def test_sample_matches_sql(spark):
    got = exact_dedup.op11_exact_dedup(spark, helpers.SF)
    assert helpers.rows(got.select(sorted(got.columns))) == helpers.sql_rows(exact_dedup.SQL)


def test_no_python_on_the_main_path(spark):
    plan = exact_dedup.op11_exact_dedup(spark, helpers.SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
