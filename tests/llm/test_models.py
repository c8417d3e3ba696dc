"""Language identification, toxicity and language-model scores against slow versions and held-out labels."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import helpers
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordermill.llm import eliasfano, language, ngram_lm, toxicity
from ordermill.llm.common import crc32_mod

SF1 = f"{helpers.DATA}/sf0.01"


def small_trees():
    texts = {"x": [b"banana bandana", b"ban an nab"], "y": [b"der die das und", b"\xc3\xa9t\xc3\xa9 und"]}
    counts = {n: Counter(np.concatenate([language.grams(t) for t in ts]).tolist()) for n, ts in texts.items()}
    codes = np.array(sorted(set(counts["x"]) | set(counts["y"])))
    return language.ContextTrees(["x", "y"], codes, np.array([[counts[n][c] for n in "xy"] for c in codes], dtype=float)), texts


def slow_bits(texts, text):
    """Code length by walking the contexts of three, two, one and no bytes."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        s = [0, 0, 0, *language.SYMBOL[list(t)].tolist()]
        for at in range(3, len(s)):
            for order in range(4):
                seen[order][tuple(s[at - order : at])][s[at]] += 1
    total, s = 0.0, [0, 0, 0, *language.SYMBOL[list(text)].tolist()]
    for at in range(3, len(s)):
        p = 1.0
        for order in (3, 2, 1, 0):
            context = seen[order][tuple(s[at - order : at])]
            n, d = sum(context.values()), len(context)
            if context[s[at]]:
                p *= context[s[at]] / (n + d)
                break
            if n:
                p *= d / (n + d)
        else:
            p /= language.SYMBOLS
        total -= math.log2(p)
    return total


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="banderu éz.", max_size=40))
def test_code_lengths_are_those_of_the_trees(text):
    trees, texts = small_trees()
    got = trees.code_lengths([text.encode()])[0]
    assert got == pytest.approx([slow_bits(texts[n], text.encode()) for n in "xy"], rel=1e-4, abs=1e-3)


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in language.op8_language(spark, SF1).collect()}
    truth = dict(duckdb.execute(f"select doc_id, lang from '{SF1}/documents.parquet'").fetchall())
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)


def test_language_of_odd_documents(spark):
    docs = helpers.edge(spark)
    model = language.learn(docs, crc32_mod("doc_id", 4) < 9)
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language.identify(docs, model).collect())
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == got[(10, "und")] == 1
    assert got[(5, "en")] == 2 and sum(got.values()) == len(helpers.EDGE)
    assert {r["doc_id"] for r in language.identified(docs, model).collect()} == {4, 5, 6, 7, 8, None}
    assert language.identified(docs, model).columns == docs.columns
    nothing = language.learn(helpers.none(spark), crc32_mod("doc_id", 4) < 9)
    assert nothing.languages == []
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(helpers.none(spark), model).count() == 0


def test_language_of_long_and_repeated_training_texts(spark, monkeypatch):
    """A language with only texts longer than a piece is learned; a text that repeats counts once, whatever its ids."""
    monkeypatch.setattr(language, "PIECE_CHARACTERS", 300)
    greek = "\u03b7 \u03b3\u03bb\u03ce\u03c3\u03c3\u03b1 \u03bc\u03b1\u03c2 \u03b5\u03af\u03bd\u03b1\u03b9 \u03bc\u03b5\u03b3\u03ac\u03bb\u03b7\n"
    rows = [(1, greek * 400, "el", "a"), (2, "plain words of the other language", "en", "a")]
    model = language.learn(helpers.frame(spark, rows), F.lit(True))
    assert model.languages == ["el", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(helpers.frame(spark, rows), model).collect()}
    assert got == {1: "el", 2: "en"}
    pieces = language.labelled_pieces(helpers.frame(spark, rows[:1]), F.lit(True)).collect()
    assert "".join(r["text"] for r in pieces) == rows[0][1] and max(len(r["text"]) for r in pieces) == 300
    more = rows + [(None, rows[0][1], "el", "b")] * 50 + [(k, rows[1][1], "en", "b") for k in range(9, 60)]
    again = language.learn(helpers.frame(spark, more).repartition(5), F.lit(True))
    assert again.languages == model.languages
    text = [rows[0][1].lower().encode(), rows[1][1].encode()]
    letters = pa.array([True, True])
    both = [[list(x) for x in m.predictions(pa.array(text), letters)] for m in (again, model)]
    assert both[0] == both[1]


SLURS = ("gromble", "vexnog", "snarkitty", "blorptard")


def labelled(n, seed=1):
    """Plain documents; one in four has two or three slurs among its words."""
    random = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "ne", "ru", "ta", "si", "po", "ha", "the", "an", "er", "ing", "ion"]

    def word():
        return "".join(random.choice(syllables, random.integers(1, 4)))

    out = []
    for k in range(n):
        text, bad = [word() for _ in range(random.integers(20, 200))], k % 4 == 0
        for _ in range(random.integers(2, 4) if bad else 0):
            text.insert(random.integers(0, len(text)), random.choice(SLURS))
        out.append((" ".join(text).encode(), int(bad)))
    return out


def test_toxicity_of_held_out_documents_and_misspellings():
    rows = labelled(900)
    model = toxicity.fit(*map(list, zip(*rows[:700])))
    scores = model.scores([t for t, _ in rows[700:]], {})
    caught = [s >= toxicity.THRESHOLD for s, (_, bad) in zip(scores, rows[700:]) if bad]
    blamed = [s >= toxicity.THRESHOLD for s, (_, bad) in zip(scores, rows[700:]) if not bad]
    assert np.mean(caught) >= 0.9 and np.mean(blamed) <= 0.02
    clean = model.word_values([b"kalomi", b"thering"]).max()
    assert (model.word_values([b"grommble", b"vexnogg", b"snarkity"]) > clean + 1).all()
    # one toxic word at the end of a very long text counts, a repeated harmless one does not
    long = b"kalo mine ruta " * 4_000
    assert model.scores([long + b"gromble vexnog"], {})[0] > 10 * model.scores([long], {})[0]
    assert model.scores([b"mine " * 500], {})[0] < toxicity.THRESHOLD


def test_toxicity_of_odd_documents(spark):
    model = toxicity.fit(*map(list, zip(*labelled(300))))
    docs = helpers.edge(spark)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(helpers.EDGE) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.score(helpers.none(spark), model).count() == 0


def test_toxicity_without_both_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(helpers.edge(spark), empty)
    assert {round(r["score"], 6) for r in toxicity.score(helpers.edge(spark), model).collect()} == {0.0}
    ones = spark.createDataFrame([(k, 1, 1) for k in range(1, 11)] + [(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(helpers.edge(spark), ones)
    assert all(r["score"] > 0.99 for r in toxicity.score(helpers.edge(spark), model).collect())


def plain_score(model, text):
    """One text's score, n-gram by n-gram in whole numbers."""
    words = []
    for word in text.lower().split():
        word = word.strip(b".,;:!?\"'()[]") or word
        if not words or words[-1] != word:
            words.append(word)

    def value(word):
        marked, found = b"<" + word + b">", []
        for n in range(3, 6):
            for at in range(len(marked) - n + 1):
                h = 0
                for byte in marked[at : at + n]:
                    h = (h * 1_099_511_628_211 + byte + 1) % 2**64
                found.append(model.weights[(h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - 17)])
        return sum(found) / len(found)

    known = {w: value(w) for w in set(words)}
    margin = model.bias
    if words:
        margin += max(sum(known[w] for w in words[at : at + 16]) / 16 for at in range(0, max(1, len(words) - 8), 8))
    return 1 / (1 + math.exp(-min(40, max(-40, model.slope * margin + model.shift))))


def test_toxicity_query_against_a_plain_computation(spark):
    docs, labels = (spark.read.parquet(f"{helpers.SF}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity(spark, helpers.SF).collect()}
    assert got == pytest.approx({i: plain_score(model, (t or "").encode()) for i, t in helpers.texts().items()}, abs=1e-9)


def test_toxicity_learns_one_text_of_an_id(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, f"text {k % 3}", "en", "a") for k in range(300)] + [(2, "plain", "en", "a"), (2, None, "en", "a")]
    one = toxicity.training_sample(helpers.frame(spark, rows), labels, F.lit(True))
    assert len(one[0]) == 2 and one[1] == [1, 0]
    assert toxicity.training_sample(helpers.frame(spark, rows[::-1]).repartition(7), labels, F.lit(True)) == one


def test_toxicity_query(spark):
    rows = toxicity.op9_toxicity(spark, helpers.SF).collect()
    assert {r["doc_id"] for r in rows} == set(helpers.texts())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=80), st.lists(st.integers(0, 2**46), max_size=30))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, dtype=np.uint64))
    sequence = eliasfano.EliasFano(values, eliasfano.MappedFile())
    assert sequence.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.array([*asked, *values.tolist()], dtype=np.uint64)
    place, equal = sequence.successor(asked)
    assert place.tolist() == np.searchsorted(values, asked).tolist()
    assert equal.tolist() == np.isin(asked, values).tolist()


@pytest.mark.parametrize("repeats", [1, 40, 70, 300])
def test_elias_fano_at_every_length(repeats):
    """Bit vectors that fill their last word, and numbers that occur very often."""
    for size in range(1, 200):
        values = np.sort(np.concatenate((np.arange(size) * 3, np.full(repeats, size // 2 * 3)))).astype(np.uint64)
        sequence = eliasfano.EliasFano(values, eliasfano.MappedFile())
        asked = np.arange(3 * size + 5, dtype=np.uint64)
        place, equal = sequence.successor(asked)
        assert place.tolist() == np.searchsorted(values, asked).tolist()
        assert equal.tolist() == np.isin(asked, values).tolist()
        assert sequence.access(np.arange(len(values))).tolist() == values.tolist()


def slow_scores(documents):
    """n_tokens, n_known, train_tokens, base and model score of (id, text, train) by plain dictionaries."""
    tokens = [helpers.lower_ascii(t).encode().split() for _, t, _ in documents]
    train = [k for k, d in enumerate(documents) if d[2]]
    count = Counter(w for k in train for w in tokens[k])
    total, kinds = sum(count.values()) + len(train), len(count) + bool(train)
    signed = {w: int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64)) for w in count}
    heads = sorted(count, key=lambda w: (-count[w], signed[w]))[: ngram_lm.CLASSES - 3]
    number = {w: k + 3 for k, w in enumerate(heads)}
    rows = [[2, 2, *(number.get(w, 0) for w in ws), 1] for ws in tokens]
    c = [Counter(), Counter(), Counter()]
    for k in train:
        for at in range(2, len(rows[k])):
            for order in range(3):
                c[order][tuple(rows[k][at - order : at + 1])] += 1
    sums, followers = Counter(), Counter()
    for order in (1, 2):
        for key, n in c[order].items():
            sums[key[:-1]] += n
            followers[key[:-1]] += 1

    def p(key):
        if len(key) == 1:
            return (c[0][key] + 1) / (total + 2 + len(heads))
        lower, n = p(key[1:]), sums[key[:-1]]
        d = ngram_lm.DISCOUNT
        return (max(c[len(key) - 1][key] - d, 0) + d * followers[key[:-1]] * lower) / n if n else lower

    tail = [w for w in count if w not in number]
    tail_total = sum(count[w] for w in tail) + len(tail) + 1
    out = []
    for k, ws in enumerate(tokens):
        base = [math.log10((n + 1) / (total + kinds + 1)) for n in (*(count[w] for w in ws), len(train))]
        score = sum(math.log10(p(tuple(rows[k][at - 2 : at + 1]))) for at in range(2, len(rows[k])))
        score += sum(math.log10((count[w] + 1) / tail_total) for w in ws if w not in number)
        known = sum(count[w] > 0 for w in ws) + bool(train)
        out.append((documents[k][0], len(ws) + 1, known, total, sum(base), score))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def check_scores(frame, documents):
    got = sorted(frame.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    expected = slow_scores(documents)
    assert len(got) == len(expected)
    for r, (doc_id, n, known, total, base, score) in zip(got, expected):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc_id, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(score, abs=1e-3 * n)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


BYTES = [b"a", b"B", b" ", b"\n", b"\x0b", "é".encode(), b"\x85", b"\xa0", b"Z", b"\x00", b"\x1c", b"wordy"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BYTES), max_size=12), min_size=1, max_size=5), st.sampled_from([1, 2, 7, 1 << 16]), st.integers(0, 1))
def test_words_have_one_hash_wherever_they_stand(texts, chunk, skipped):
    texts, was = [b"".join(t) for t in texts], ngram_lm.CHUNK_BYTES
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary()), pa.array([True] * len(texts))], names=["i", "text", "train"])
    ngram_lm.CHUNK_BYTES = chunk
    ngram_lm._POWERS.clear()
    try:
        got = [h.tolist() for *_, h in ngram_lm.split_documents(rows.slice(skipped))]
    finally:
        ngram_lm.CHUNK_BYTES = was
        ngram_lm._POWERS.clear()
    assert got == [[int(ngram_lm.word_hashes(w)[0]) for w in t.lower().split()] for t in texts[skipped:]]


def test_different_words_have_different_hashes():
    words = {w for t in helpers.texts(SF1).values() for w in (t or "").lower().encode().split()}
    words |= {b"%d" % k for k in range(200_000)} | {b"a" * k for k in range(1, 300)} | {b"ab" * k for k in range(1, 300)}
    assert len({int(ngram_lm.word_hashes(w)[0]) for w in words}) == len({w.lower() for w in words})
    assert not set(ngram_lm.MARKS.tolist()) & {int(ngram_lm.word_hashes(w)[0]) for w in words}


def test_more_hot_words_than_numbers_are_refused(monkeypatch):
    monkeypatch.setattr(ngram_lm, "CLASSES", 5)
    none = np.zeros(0, int)
    ngram_lm.lower_orders([(1, 9), (2, 9)], 18, 2, 1, none, none)
    with pytest.raises(ValueError):
        ngram_lm.lower_orders([(1, 9), (2, 9), (3, 9)], 27, 3, 1, none, none)


def test_scores_of_the_sample(spark):
    documents = [(i, t, not held(i)) for i, t in helpers.texts(SF1).items()]
    frame = ngram_lm.op10_ngram_lm(spark, SF1).cache()
    check_scores(frame, documents)
    out = [r for r in frame.collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_documents(spark):
    frame = ngram_lm.score(helpers.edge(spark), crc32_mod("doc_id", 7) != 2)
    check_scores(frame, [(r[0], r[1], not held(r[0])) for r in helpers.EDGE])


def test_scores_with_nothing_learned(spark):
    frame = ngram_lm.score(helpers.edge(spark), crc32_mod("doc_id", 7) > 9)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in frame.collect())
    assert ngram_lm.score(helpers.none(spark), crc32_mod("doc_id", 7) != 2).count() == 0


def test_shards_of_a_context_hold_all_its_successors():
    """Several blocks over several shards add up to what one shard gives."""
    random = np.random.default_rng(2)
    documents = [(k, k % 5 > 0, random.integers(1, 60, random.integers(0, 90)).astype(np.uint64)) for k in range(60)]
    counts = Counter(int(h) for _, t, hs in documents if t for h in hs)
    heads = [(h, n) for h, n in counts.most_common(30)]
    trained = [hs for _, t, hs in documents if t]
    first = ngram_lm.lower_orders(heads, sum(counts.values()) + len(trained), len(counts) + 1, len(trained), np.zeros(0, int), np.zeros(0, int))
    pairs = ngram_lm.summed(ngram_lm.sequences([first.classes(h) for h in trained]) % ngram_lm.CLASSES**2)
    lower = ngram_lm.lower_orders(heads, first.tokens, first.types, len(trained), *pairs)

    def scores(shards, cuts):
        blocks = [ngram_lm.block(documents[a:b], lower, shards) for a, b in zip(cuts, cuts[1:])]
        answers = [list(ngram_lm.answer(list(ngram_lm.opened(pa.array([b[k] for b in blocks]))), lower)) for k in range(shards)]
        return np.concatenate([ngram_lm.combined([a[k] for a in answers])[5] for k in range(len(blocks))]).tolist()

    assert scores(7, [0, 13, 14, 60]) == pytest.approx(scores(1, [0, 60]))


def test_rare_words_have_pairs_and_triples_of_their_own(spark):
    """3,000 words of one frequency, each known by the two before it."""
    text = " ".join(f"w{k}" for k in range(3_000))
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, text, "en", "a")]
    got = {r["doc_id"]: r for r in ngram_lm.score(helpers.frame(spark, rows), F.col("doc_id") < 3).collect()}
    d, p = ngram_lm.DISCOUNT, 3 / (2 * 3_001 + 3_002)
    for _ in range(2):
        p = (2 - d + d * p) / 2
    assert got[3]["held_out"] and got[3]["n_known"] == 3_001
    assert got[3]["score"] == pytest.approx(3_001 * math.log10(p), rel=1e-6)


def test_frequent_contexts_are_split_over_shards(spark, monkeypatch):
    """A word that begins a third of all paths and a pair that begins nearly as many: even messages, the same scores."""
    random = np.random.default_rng(3)
    texts = [" ".join(f"the of x{k}" for k in random.integers(0, 5_000, random.integers(0, 120))) for _ in range(150)]
    documents = [(i, t, not held(i)) for i, t in enumerate(texts)]
    monkeypatch.setattr(ngram_lm, "HOT_TOKENS", 300)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 4_000)
    frame = helpers.frame(spark, [(i, t, "en", "a") for i, t, _ in documents])
    check_scores(ngram_lm.score(frame, crc32_mod("doc_id", 7) != 2), documents)

    lower = ngram_lm.learn_lower(ngram_lm.training_texts(frame, crc32_mod("doc_id", 7) != 2))
    assert len(lower.heads) == 4 and len(lower.pairs) >= 2
    block = [(i, t, ngram_lm.word_hashes(s.encode())) for i, s, t in documents]
    sent = [ngram_lm.block(block, lower, 8, home) for home in range(2)]
    assert max(map(len, sent[0][1:])) < 1.5 * min(map(len, sent[0][1:]))
    about = [[next(ngram_lm.opened(pa.array([m])))[2] is not None for m in messages] for messages in sent]
    assert [a.index(True) for a in about] == [0, 1] and all(sum(a) == 1 for a in about)


def test_every_level_of_a_shard_is_a_mapped_elias_fano_sequence():
    trie = ngram_lm.ShardTrie(np.array([3, 4, 11]), np.array([8, 19]), np.array([2, 1, 5]), 9)
    for level in (trie.words, trie.word_starts, trie.pairs, trie.pair_starts, trie.triples):
        assert isinstance(level, eliasfano.EliasFano) and isinstance(level.high, np.memmap)
    found = trie.look_up(np.array([0, 2, 5]), np.array([0, 1]), np.array([8, 1]), np.array([0, 0, 1, 1]), np.array([3, 4, 2, 3]))
    assert [v.tolist() for v in found] == [[3, 5, 0], [1, 1, 0], [3, 5], [2, 1], [2, 1, 5, 0]]
