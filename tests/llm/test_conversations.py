"""Conversation repair against a search over all edits, and the damage rules row by row."""

import hashlib
import itertools
import random
import re
import zlib

import helpers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordermill.llm import conversations as c

DDL = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        said = WORD.findall(text)
        if not said:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def brute(rows):
    """Least (cost, edits) and the repaired rows, of every way to edit with an insertion or two in each gap."""
    judged = faults(rows)
    options = []
    for (role, text), fault in zip(rows, judged):
        own = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own.append((more, "K", [(role, text)]))
            own += [(3 + more, "R", [(new, text)]) for new in ("user", "assistant")]
        options.append(own)
    gap = [(3 * n, "I" * n, [(r, "") for r in new]) for n in range(3 if len(rows) < 3 else 2) for new in itertools.product(("user", "assistant"), repeat=n)]
    steps = [gap]
    for own in options:
        steps += [own, gap]
    best = None
    for chosen in itertools.product(*steps):
        kept = [row for _, _, new in chosen for row in new]
        if all(role for role, _ in kept) and PATTERN.fullmatch("".join(role[:1] for role, _ in kept)):
            one = (sum(cost for cost, _, _ in chosen), "".join(edit for _, edit, _ in chosen), kept)
            best = one if best is None or one[:2] < best[:2] else best
    return best


def audit(rows, **options):
    found = c.Audit(**options)
    for turn, (role, text) in enumerate(rows):
        found.row(turn, role, text)
    return found.result()


def applied(rows, edits):
    lines = [(1, 0, None, "", edits)] + [(1, 1, turn, *row) for turn, row in enumerate(rows)]
    return [(role, text) for _, _, _, role, text, _ in c._applied(iter(lines))]


ROLE = st.sampled_from(["user", "assistant", "system", "tool", "u2", ""])
TEXT = st.sampled_from(["a.", "b!", "c", " ", "d?", "e"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=4))
def test_cheapest_edits(rows):
    cost, edits, kept = brute(rows)
    for prime in (c.PRIME, 3):  # with three hash values nearly all prefixes collide
        found = audit(rows, prime=prime)
        assert found[-2:] == (cost, edits)
    assert applied(rows, edits) == kept


def plain_search(rows):
    """The same search with whole strings for paths."""
    best = {0: (0, "")}

    def offer(found, place, one):
        if place not in found or one < found[place]:
            found[place] = one

    def close(found):
        for place in (0, 1, 3, 2):
            if place in found:
                offer(found, c.STEPS[place][c.EXPECTED[place]], (found[place][0] + 3, found[place][1] + "I"))

    close(best)
    for (role, _), fault in zip(rows, faults(rows)):
        found, more = {}, 3 if fault == "truncated" else 0
        for place, (cost, edits) in best.items():
            offer(found, place, (cost + 4, edits + "D"))
            if fault not in ("blank", "duplicate"):
                if role[:1] in c.STEPS[place]:
                    offer(found, c.STEPS[place][role[:1]], (cost + more, edits + "K"))
                offer(found, c.STEPS[place][c.EXPECTED[place]], (cost + 3 + more, edits + "R"))
        best = found
        close(best)
    return min(best[p] for p in (0, 3) if p in best)


@pytest.mark.parametrize("roles", [["tool"], ["user"], ["user", "assistant", "system"], ["user", "assistant"]])
def test_long_conversations_rebuild_the_tree(roles):
    draw = random.Random(len(roles))
    rows = [(draw.choice(roles), f"{draw.randrange(500)}{draw.choice('.!?ab ')}") for _ in range(1_500)]
    for prime in (c.PRIME, 5):
        assert audit(rows, prime=prime, nodes=40)[-2:] == plain_search(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from("DIKR")), min_size=1, max_size=40), st.sampled_from([2, 3, c.PRIME]))
def test_paths_compare_as_their_texts(steps, prime):
    tree = c.Edits(prime)
    for parent, edit in steps:
        tree.add(parent % len(tree), edit)
    paths = [tree.path(n) for n in range(len(tree))]
    for a, b in itertools.product(range(len(tree)), repeat=2):
        assert tree.before(a, b) == (paths[a] < paths[b])


def test_only_shared_paths_are_kept():
    found = c.Audit(nodes=64)
    for turn in range(5_000):
        found.row(turn, ("user", "assistant")[turn % 2], f"{turn}.")
    assert len(found.tree) <= 80
    assert found.result()[-2:] == (0, "K" * 5_000)


def damage(rows):
    """Rows after damage: (conv_id, turn, role, text), in order within a conversation."""
    found = []
    for conv_id, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        found += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(found, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows):
    found, after = [], damage(rows)
    for conv_id in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv_id]
        said = [r[2:] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = faults(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, edits = plain_search(said)
        text = "\n".join(f"{role}:{text}" for role, text in applied(said, edits))
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        found.append((conv_id, gaps, *counts, illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def run(spark, rows, tmp_path, extra=()):
    frame = spark.createDataFrame(rows, DDL)
    for name in extra:
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return helpers.rows(c.op12_conversations(spark, str(tmp_path)))


def test_random_tables(spark, tmp_path):
    draw = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["a.", "b!", "c", " ", None, "", "Ü?", "long " * 3_000 + "."]
    ids = [*range(60), None]
    rows = [
        (draw.choice(ids), draw.choice([None, *range(12), 1 << 40]), draw.choice(roles), draw.choice(texts)) for _ in range(900)
    ]
    rows += rows[:50] + [(99, t, "user", f"{t}.") for t in range(1_200)]
    got = run(spark, rows, tmp_path, extra=("dropped", "_kind", "_time", "audit", "seq"))
    assert got == expected(rows)


def test_conversations_of_which_nothing_is_left(spark, tmp_path):
    gone = [i for i in range(2_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows = [(i, 0, "user", "a.") for i in gone] + [(-1, 3, "user", "a.")]
    got = run(spark, rows, tmp_path)
    assert got == expected(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert [g for g in got if g[0] in gone] == [(i, 0, 0, 0, 0, 0, 0, "", empty) for i in sorted(gone, key=str)]


def test_no_conversations(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_repaired_rows_fit_the_pattern(spark):
    rows = spark.read.parquet(f"{helpers.SF}/conversations.parquet")
    found = {}
    for row in c.repaired(rows, c.audited(rows)).collect():
        found.setdefault(row["conv_id"], []).append((row["seq"], row["role"]))
    assert found
    for own in found.values():
        assert [seq for seq, _ in sorted(own)] == list(range(len(own)))
        assert PATTERN.fullmatch("".join(role[0] for _, role in sorted(own)))


def test_sample_matches_sql(spark):
    got = c.op12_conversations(spark, helpers.SF)
    assert helpers.rows(got.select(sorted(got.columns))) == helpers.sql_rows(c.SQL)
