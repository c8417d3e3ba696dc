"""Quality rules: a decision list learned by sequential covering, applied as Spark expressions (operator 4).

Statistics of whole texts come from built-in functions alone; nothing leaves the JVM and nothing is shuffled. Repeated
windows are found within the row: a set of window hashes tells whether there are any, and only for texts that have some
the hashes are sorted with their places.

Rules are learned from a bounded sample of labelled documents. A rule is a conjunction of thresholds that grows by the
condition with the highest information gain on one part of the sample, loses its last conditions where the other part
says so, and joins the list if that part finds it precise. What it covers is set aside, and the next one grows on the rest. The list
becomes one conditional expression, first match first.

Defined results: a null or empty text has zeros and fails the base rule; repeated rows get a row each; without
labels of both kinds the list is empty and keeps what passes the base rule; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_text, table, words
from .registry import query

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = r"[^#*$%&|<>]+"

#: Labelled documents of either kind in the sample that rules are learned from.
SAMPLE_EACH = 2_500
#: Thresholds tried per statistic, conditions per rule, rules per list, and the precision a rule needs on the pruning part.
CUTS = 48
CONDITIONS = 4
RULES = 12
PRECISION = 0.9
LEAST_COVER = 5


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the base statistics as further columns: ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines`` and ``n_repeat_words``. Columns of these names must not exist yet.

    Write the result before filtering on a statistic: the optimizer would put its whole expression into the filter."""
    size = WINDOW_WORDS
    named = docs.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_words": words(F.col(text))})
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    counted = named.withColumns({"_lines": lines, "_hashes": hashes}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    places = F.sequence(F.lit(0), F.size("_hashes") - size)
    windows = F.when(
        F.size("_hashes") >= size, F.transform(places, lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))
    windowed = counted.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = windowed.withColumn("_sorted", sorted_)
    pairs = F.col("_sorted")

    def starts_repeat(k: Column) -> Column:
        same_before = (k > 0) & (F.get(pairs, k - 1)["h"] == F.get(pairs, k)["h"])
        same_after = F.get(pairs, k + 1)["h"] == F.get(pairs, k)["h"]
        return same_before | F.coalesce(same_after, F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), starts_repeat)
    starts = F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get(pairs, k)["i"])))
    placed = ranked.withColumn("_starts", starts)
    # a window covers as many words as lie before the next repeated window, at most its size
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_starts") - 1),
        F.lit(0),
        lambda total, k: total + F.least(F.lit(size), F.get("_starts", k) - F.get("_starts", k - 1)),
    )
    repeated = F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(covered + size)
    helpers = ("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")
    return placed.withColumn("n_repeat_words", repeated.cast("long")).drop(*helpers)


def base_failed() -> Column:
    too_repetitive = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | too_repetitive


#: What rules may test: name and expression over the base statistics.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_lines_per_word": lambda: F.col("n_dup_lines") / F.greatest("n_words", F.lit(1)),
    "repeated_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return (values[self.feature] > self.threshold) == self.above

    def expression(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold


def covers(rule: list[Condition], values: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, dtype=bool)
    for condition in rule:
        out &= condition.mask(values)
    return out


def gain(p: int, n: int, before: tuple[int, int]) -> float:
    """FOIL's information gain of narrowing ``before`` bad and good rows to p and n."""
    if not p:
        return 0.0
    return p * (np.log2(p / (p + n)) - np.log2(before[0] / sum(before)))


def cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds to try: midway between a quantile of the values and the next value above it."""
    distinct = np.unique(values)
    at = np.searchsorted(distinct, np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="lower")))
    at = at[at + 1 < len(distinct)]
    return (distinct[at] + distinct[at + 1]) / 2


def grow_rule(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for feature, column in values.items():
            for cut in cuts(column[inside]):
                for above in (True, False):
                    condition = Condition(feature, above, float(cut))
                    now = inside & condition.mask(values)
                    better = gain(int(bad[now].sum()), int((~bad[now]).sum()), (p, n))
                    if better > best[0]:
                        best = better, condition
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].mask(values)
    return rule


def prune_rule(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule that does best on rows it was not grown on."""

    def worth(part: list[Condition]) -> float:
        inside = covers(part, values, len(bad))
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn_list(rows: list[dict], seed: int = 5) -> list[list[Condition]]:
    """Rules for bad documents, in the order they are to be tried; ``rows`` hold the features and ``bad``."""
    bad = np.array([bool(r["bad"]) for r in rows])
    if not len(bad) or bad.all() or not bad.any():
        return []
    values = {name: np.array([float(r[name]) for r in rows]) for name in FEATURES}
    growing = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), dtype=bool)
    rules: list[list[Condition]] = []

    def part(mask: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {name: column[mask] for name, column in values.items()}, bad[mask]

    while len(rules) < RULES and bad[left & growing].any():
        rule = prune_rule(grow_rule(*part(left & growing)), *part(left & ~growing))
        inside = covers(rule, values, len(bad)) & left
        held = inside & ~growing
        if not rule or inside.sum() < LEAST_COVER or bad[inside].mean() < PRECISION or (held.any() and bad[held].mean() < PRECISION):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Whether the list keeps a document: the first rule that matches rejects it."""
    out = F.lit(True)
    for rule in reversed(rules):
        matches = rule[0].expression()
        for condition in rule[1:]:
            matches &= condition.expression()
        out = F.when(matches, F.lit(False)).otherwise(out)
    return out


def learned_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """A list from a bounded sample of labelled documents: of either kind, the ids that come first by a hash, one text of each."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") < 1).alias("bad"))
    parts = [known.where(want).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH) for want in (F.col("bad"), ~F.col("bad"))]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * SAMPLE_EACH rows
    sample = with_statistics(one_text(docs.select("doc_id", "text").join(ids, "doc_id"), "bad"))
    features = [make().alias(name) for name, make in FEATURES.items()]
    rows = sample.select("doc_id", "bad", base_failed().alias("failed"), *features).collect()
    # rules are for what the base rule lets through; a filter in the plan would repeat the statistics inside it
    return learn_list(sorted((r.asDict() for r in rows if not r["failed"]), key=lambda r: r["doc_id"]))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the base statistics, ``base_failed`` and ``kept`` of every row."""
    counted = with_statistics(docs.select("doc_id", "text"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learned_rules(docs, table(spark, sf_dir, "labels")))
