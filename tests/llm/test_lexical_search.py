"""Ranked lexical search against a plain scan."""

import math
import re
from collections import Counter

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordermill.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(helpers.lower_ascii(text))


def brute(docs, items, best=search.BEST):
    found = [(doc_id, Counter(own)) for doc_id, text, *_ in docs if (own := terms(text))]
    n_docs, length = len(found), sum(sum(own.values()) for _, own in found)
    df = Counter(t for _, own in found for t in own)
    ranked = []
    for item_id, text in items:
        scored = []
        for doc_id, own in found:
            m = 100 - 50 + (50 * sum(own.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 20 * m))
                for t in set(terms(text))
                if t in own
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        ranked += [(item_id, at + 1, s[3], -s[0]) for at, s in enumerate(sorted(scored, key=lambda s: s[:3])[:best])]
    return sorted(ranked, key=repr)


ITEMS = [
    (1, "The QUICK fox, the lazy dog!"),
    (2, "w5x5 w6x6 w7x7 words of several"),
    (2, "fox dog"),
    (3, None),
    (4, " .,;\n"),
    (None, "été あ a-b c"),
    (6, "x" * 120_000 + " one WORD"),
    (7, "notfoundanywhere"),
]


@pytest.mark.parametrize(("best", "limit", "most"), [(50, 1 << 20, 1_024), (2, 60, 3), (3, 1 << 20, 1)])
def test_edge_rows(spark, best, limit, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as item", "'x' as rank", "2 as doc_id")
    found = search.search(helpers.edge(spark), items, best, limit, most)
    assert helpers.rows(found) == brute(helpers.EDGE, ITEMS, best)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(helpers.none(spark), items).count() == 0
    assert search.search(helpers.edge(spark), items.limit(0)).count() == 0
    blank = helpers.frame(spark, [(1, None, None, None), (2, " ..", None, None)])
    assert search.search(blank, items).count() == 0


def test_copies_of_a_document_tie(spark):
    docs = [(i % 700, "the quick brown fox" if i % 3 else f"the fox {i}", "en", "a") for i in range(2_000)]
    items = [(1, "quick fox"), (2, "the")]
    found = search.search(helpers.frame(spark, docs).repartition(9), spark.createDataFrame(items, "item_id long, text string"))
    assert helpers.rows(found) == brute(docs, items)


def test_merging_in_two_rounds(spark):
    lists = [(item, part, part * 7 % 1_000, part % 13) for item in range(3) for part in range(1_500)]
    found = search.merged(spark.createDataFrame(lists, "item long, part long, doc_id long, score long"), 20)
    for item in range(3):
        best = sorted((r for r in lists if r[0] == item), key=lambda r: (-r[3], r[2]))[:20]
        got = sorted((r["rank"], r["doc_id"], r["score"]) for r in found.where(f"item = {item}").collect())
        assert got == [(at + 1, r[2], r[3]) for at, r in enumerate(best)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbZ09 .-_@[`{\x7f\x00éÉİ\x85\xa0あ", max_size=40), st.sets(st.text(alphabet="abz09é\xa0あ", min_size=1, max_size=3)))
def test_automaton_counts_whole_terms(text, wanted):
    import ahocorasick

    names = sorted(wanted)
    words = ahocorasick.Automaton()
    for number, term in enumerate(names):
        words.add_word(f" {term} ", number)
    found = Counter()
    if names:
        words.make_automaton()
        found = Counter({names[k]: n for k, n in search.frequencies(words, text.encode()).items()})
    assert found == Counter(t for t in terms(text) if t in wanted)
    assert [t.decode() for t in search.terms(text.encode())] == terms(text)


def test_blocks_are_bounded():
    items = [(n, f"word{n} word{n + 1} word{n + 2}".encode()) for n in range(50)]
    dealt = list(search.blocks(items, limit=100, most=7))
    assert np.concatenate([b.numbers for b in dealt]).tolist() == list(range(50))
    assert all(sum(map(len, b.terms)) <= 100 and len(b.numbers) <= 7 for b in dealt)
    for block in dealt:
        for t, term in enumerate(block.terms):
            held = {int(block.numbers[i]) for i in block.items[block.starts[t] : block.starts[t + 1]]}
            assert held == {n for n, text in items if term.encode() in text.split() and n in block.numbers}


def test_sample_matches_sql(spark):
    got = search.op13_lexical_search(spark, helpers.SF)
    assert helpers.rows(got.select(sorted(got.columns))) == helpers.sql_rows(search.SQL)
