"""The pipeline's stages one by one, each against the operator's own verdicts on the stage's input."""

from collections import Counter

import helpers
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from ordermill.llm import language, mixing, packing, simhash, toxicity
from ordermill.llm.common import table, written

SF1 = f"{helpers.DATA}/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = table(spark, SF1, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF1), f"test-{name}"))
    return out


def ids(frame):
    return Counter(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "mixing", "packing"]
    assert all(frame.columns == COLUMNS for frame in outputs[:-1])


def test_toxic_documents_go(spark, outputs):
    model = toxicity.fitted(outputs[0], table(spark, SF1, "labels"))
    assert ids(outputs[1]) == ids(toxicity.score(outputs[0], model).where("predicted = 0"))


def test_documents_without_a_language_go(outputs):
    verdicts = language.identify(outputs[1], language.learned(outputs[1]))
    kept = verdicts.where(f"lang_pred != 'und' and score >= {language.LEAST_SCORE}")
    assert ids(outputs[2]) == ids(kept)
    assert outputs[2].count() >= 0.99 * outputs[1].count()


def test_one_of_each_group_stays(outputs):
    found = simhash.near_duplicates(outputs[2])
    assert ids(outputs[3]) == Counter(r[0] for r in found.select("component_id").distinct().collect())


def test_the_mix_takes_what_it_plans(spark, outputs):
    plan = mixing.mix(outputs[3], mixing.quality_weights(table(spark, SF1, "labels")))
    assert ids(outputs[4]) == Counter({r["doc_id"]: r["times"] for r in plan.collect() if r["times"]})


def test_all_of_the_mix_is_packed(outputs):
    got = outputs[5].collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == ids(outputs[4])
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= packing.MAX_TOKENS
    assert len(sizes) <= 1.02 * sum(sizes.values()) / packing.MAX_TOKENS + 1


def test_run_gives_what_the_stages_give(spark, outputs):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    run = Counter(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, SF1).collect())
    assert run == Counter(tuple(r[k] for k in key) for r in outputs[5].collect())


def test_registered():
    names = spark_entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(spark_entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("number", range(4))
def test_stages_take_odd_documents(spark, number):
    stage = corpus_pipeline.STAGES[number][1]
    docs = helpers.edge(spark)
    assert stage(spark, docs, helpers.SF).columns == docs.columns
    assert stage(spark, helpers.none(spark), helpers.SF).count() == 0
