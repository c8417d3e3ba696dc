"""Quality statistics and license notices against plain loops and SQL, learned rules on made-up rows."""

from collections import Counter

import helpers
import numpy as np

from ordermill.llm import licenses, quality, queries

SF1 = f"{helpers.DATA}/sf0.01"


def slow_statistics(text):
    text = text or ""
    w = helpers.words(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if helpers.WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


REPEATS = [
    (20, "a b c d e f g h i " * 30, "en", "a"),
    (21, " ".join(f"x{k}" for k in range(100)) + " a b c d e f g h z a b c d e f g h", "en", "a"),
    (22, "same " * 9, "en", "a"),
    (23, "line one\nline one\n \n \nline one #*$%&|<>\n\nLine one", "en", "a"),
]


def test_statistics(spark):
    rows = helpers.EDGE + REPEATS
    got = quality.judge(helpers.frame(spark, rows), []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(r[0], *slow_statistics(r[1])) for r in rows]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judge(helpers.none(spark), []).count() == 0


def test_query_on_the_sample(spark):
    got = {r["doc_id"]: r for r in quality.op4_quality(spark, SF1).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc_id, text in helpers.texts(SF1).items():
        assert tuple(got[doc_id][n] for n in names) == slow_statistics(text)
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    import duckdb

    labels = duckdb.execute(f"select doc_id, quality from '{SF1}/labels.parquet' where quality is not null").fetchall()
    good = [got[i] for i, q in labels if q == 1 and not got[i]["base_failed"]]
    bad = [got[i] for i, q in labels if q == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_rules_are_learned_and_pruned(spark):
    random = np.random.default_rng(4)
    rows = []
    for _ in range(2_000):
        row = {name: float(random.random()) for name in quality.FEATURES}
        row["bad"] = row["symbols_per_word"] > 0.8 or (row["repeated_share"] > 0.5 and row["words"] < 0.3)
        rows.append(row)
    rules = quality.learn_list(rows)
    values = {name: np.array([r[name] for r in rows]) for name in quality.FEATURES}
    hit = np.zeros(len(rows), dtype=bool)
    for rule in rules:
        hit |= quality.covers(rule, values, len(rows))
    bad = np.array([r["bad"] for r in rows])
    assert (hit & bad).sum() >= 0.95 * bad.sum() and (hit & ~bad).sum() <= 0.02 * len(rows)
    assert quality.learn_list([]) == [] and quality.learn_list([r for r in rows if r["bad"]]) == []
    # noise alone teaches nothing
    noise = [{**r, "bad": bool(random.random() < 0.3)} for r in rows]
    assert quality.learn_list(noise) == []


def test_licenses_match_sql(spark):
    got = licenses.op5_licenses(spark, SF1)
    assert helpers.rows(got.select(*sorted(got.columns))) == helpers.sql_rows(queries.ORACLES["op5_licenses"], SF1)


def test_license_in_long_changed_and_odd_texts(spark):
    words = licenses.NOTICES["apache-2.0"].split()
    changed = words[:20] + ["whatsoever"] + words[20:]
    rows = [
        (30, helpers.LONG_WORDS + " " + licenses.NOTICES["mit"].upper() + " " + helpers.LONG_WORDS, "en", "a"),
        (31, "x y " + " ".join(changed), "en", "a"),
        (32, "Released under the Mit license", "en", "a"),
        (33, "the License shall be licensed under no conditions", "en", "a"),
        (34, " ".join(words[:12]), "en", "a"),
    ]
    found = {r["doc_id"]: {x["name"] for x in r["found"]} for r in licenses.scan(helpers.frame(spark, rows)).collect()}
    assert found[30] == {"mit"} and "apache-2.0" in found[31] and found[32] == {"mit-line"}
    assert found[33] == set() and "apache-2.0" not in found[34] and "apache-2.0-line" in found[34]
    odd = licenses.scan(helpers.edge(spark)).collect()
    assert len(odd) == len(helpers.EDGE) and all(r["found"] == [] for r in odd)
    assert licenses.scan(helpers.none(spark)).count() == 0
    assert licenses.scan(helpers.edge(spark), {}).count() == len(helpers.EDGE)


def test_windows_at_any_offset_retrieve_a_notice(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k)) + " " + licenses.NOTICES["bsd-3-clause"], "en", "a") for k in range(9)]
    assert all([x["name"] for x in r["found"]] == ["bsd-3-clause"] for r in licenses.scan(helpers.frame(spark, rows)).collect())


def test_both_run_without_python_workers(spark):
    docs = helpers.edge(spark)
    for frame in (quality.judge(docs, []), licenses.scan(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


def test_repeated_ids_bring_one_row_to_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn_list", lambda rows: seen.append(rows) or [])
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, f"{text} {k % 4}", "en", "a") for k in range(500)] + [(2, text, "en", "a"), (None, text, "en", "a")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    quality.learned_rules(helpers.frame(spark, rows), labels)
    quality.learned_rules(helpers.frame(spark, rows[::-1]).repartition(7), labels)
    assert seen[0] == seen[1] and [(r["doc_id"], r["bad"]) for r in seen[0]] == [(1, False), (2, True)]
