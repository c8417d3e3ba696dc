r"""Repair of conversation structure by a persistent audit DP (operator 12).

The rows of a conversation, in order, are edited at least cost so that the initials of the roles
give ``(s?(ua)+)?``. The state of the search is the place in that pattern: nothing yet, after a system
row, after a user row, after an assistant row. For each state the cheapest edits so far are one node of a tree
of edits: paths share their prefixes, a step adds one node. Of paths of equal cost the one with the
ASCII-least edits counts. Two paths are compared by the longest common prefix, which binary lifting
finds on rolling hashes of the prefixes; from there both are followed back to a
node they share, so colliding hashes cannot mislead. Two different paths of one state and cost differ
within the shorter one (an added insertion costs), so the choice holds whatever follows.

Conversations are shuffled by id and sorted; a task streams through them in Arrow batches and
holds the edits of the conversation at hand, never its texts. What all live paths share
is set aside and the tree rebuilt whenever it has doubled. The repaired rows come from a second pass that
reads the rows along with the edits found. Order of rows decides the edits, so one conversation
is one task's work; its memory there is some 100 bytes a row for telling repeats, and of
the edits only what the live paths do not share.

Defined results: a null role or text counts as one space, null turns come first, rows of one turn are
ordered by role and text. A null conv_id is a conversation of its own. A role counts by its first character, an empty role
by none; a row whose initial does not fit is given a new role or deleted. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .registry import query

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
ROLES = {"u": "user", "a": "assistant"}

#: Places in the pattern and where an initial leads; all but the first and last of START, USER.. need more.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
COMPLETE = (START, ASSISTANT)
#: The role that an inserted or rerolled row has in each place.
EXPECTED = ("u", "u", "a", "u")

WHITE = " \t\n\x0b\x0c\r"
PRIME, BASE = (1 << 61) - 1, 1_000_003
NODES = 1 << 14

STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Edits:
    """A tree of edits; node 0 is the empty path. Children come after their parents."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.code, self.depth, self.hash = array("b", [0]), array("q", [0]), array("q", [0])
        self.up = [array("q", [0])]  # up[k][node]: the ancestor 2^k steps above, or node 0

    def __len__(self) -> int:
        return len(self.code)

    def add(self, parent: int, edit: str) -> int:
        node, code, depth = len(self.code), ord(edit), self.depth[parent] + 1
        self.code.append(code)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * BASE + code) % self.prime)
        if depth >> len(self.up):
            self.up.append(array("q", bytes(8 * node)))
        above = parent
        for k, level in enumerate(self.up):
            level.append(above)
            above = self.up[k][above]
        return node

    def ancestor(self, node: int, depth: int) -> int:
        for k in range(len(self.up) - 1, -1, -1):
            if self.depth[node] - depth >> k:
                node = self.up[k][node]
        return node

    def before(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b``; a proper prefix comes first."""
        shorter = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, shorter), self.ancestor(b, shorter)
        differ = None
        if self.hash[x] != self.hash[y]:
            for level in reversed(self.up):
                if self.hash[level[x]] != self.hash[level[y]]:
                    x, y = level[x], level[y]
        while x != y:  # verifies the prefix; the last difference met is the first of the texts
            if self.code[x] != self.code[y]:
                differ = self.code[x] < self.code[y]
            x, y = self.up[0][x], self.up[0][y]
        return self.depth[a] < self.depth[b] if differ is None else differ

    def path(self, node: int, above: int = 0) -> str:
        found = bytearray()
        while node != above:
            found.append(self.code[node])
            node = self.up[0][node]
        return found[::-1].decode("ascii")

    def meeting(self, nodes: list[int]) -> int:
        """The deepest node on all paths; ids fall towards the root, so the largest goes up first."""
        live = set(nodes)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.up[0][last])
        return live.pop()

    def rebuilt(self, root: int, nodes: list[int]) -> tuple["Edits", list[int]]:
        """A tree of the paths from ``root`` to the nodes only, and where these are in it."""
        wanted = set()
        for node in nodes:
            while node != root and node not in wanted:
                wanted.add(node)
                node = self.up[0][node]
        tree, place = Edits(self.prime), {root: 0}
        for node in sorted(wanted):
            place[node] = tree.add(place[self.up[0][node]], chr(self.code[node]))
        return tree, [place[n] for n in nodes]


class Audit:
    """The cheapest edits of one conversation, row by row, with its faults."""

    def __init__(self, prime: int = PRIME, nodes: int = NODES):
        self.tree, self.limit, self.least_limit = Edits(prime), nodes, nodes
        self.settled: list[str] = []
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.inserts()
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last_initial = None

    def offer(self, found: dict, place: int, cost: int, parent: int, edit: str) -> None:
        known = found.get(place)
        if known is None or cost < known[0]:
            found[place] = (cost, self.tree.add(parent, edit))
        elif cost == known[0]:
            node = self.tree.add(parent, edit)
            if self.tree.before(node, known[1]):
                found[place] = (cost, node)

    def inserts(self) -> None:
        """Insertions lead from place to place, user rows first: what an assistant row adds after one leads nowhere cheaper."""
        for place in (START, SYSTEM, ASSISTANT, USER):
            if place in self.best:
                cost, node = self.best[place]
                self.offer(self.best, STEPS[place][EXPECTED[place]], cost + COST[INSERT], node, INSERT)

    def row(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        words = text.strip(WHITE)
        same = hashlib.sha256(b"%d:%s%s" % (len(role.encode()), role.encode(), text.encode())).digest()
        repeated = same in self.seen
        self.seen.add(same)
        blank, duplicate = not words, bool(words) and repeated
        truncated = bool(words) and not repeated and words[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated

        found: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if truncated else 0
        for place, (cost, node) in self.best.items():
            self.offer(found, place, cost + COST[DELETE], node, DELETE)
            if blank or duplicate:
                continue
            if initial in STEPS[place]:
                self.offer(found, STEPS[place][initial], cost + COST[KEEP] + more, node, KEEP)
            self.offer(found, STEPS[place][EXPECTED[place]], cost + COST[REROLE] + more, node, REROLE)
        self.best = found
        self.inserts()
        self.forget()
        if len(self.tree) > self.limit:
            self.settle()

    def forget(self) -> None:
        """Drop the places before the first user row once they cannot win any more.

        What completes the pattern after a system row completes it after an assistant row too; after nothing
        it does so but for one system row, which may be deleted.
        """
        cost = self.best[ASSISTANT][0]
        for place, more in ((START, COST[DELETE]), (SYSTEM, 0)):
            if place in self.best and cost + more < self.best[place][0]:
                del self.best[place]

    def settle(self) -> None:
        """Set aside what all paths share and keep only what is still on one."""
        places = list(self.best)
        nodes = [self.best[p][1] for p in places]
        root = self.tree.meeting(nodes)
        self.settled.append(self.tree.path(root))
        self.tree, nodes = self.tree.rebuilt(root, nodes)
        self.best = {p: (self.best[p][0], n) for p, n in zip(places, nodes)}
        self.limit = max(self.least_limit, 2 * len(self.tree))

    def result(self) -> tuple:
        done = [self.best[p] for p in COMPLETE if p in self.best]
        cost, node = done[0]
        for other in done[1:]:
            if other[0] < cost or (other[0] == cost and self.tree.before(other[1], node)):
                cost, node = other
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        audit = "".join(self.settled) + self.tree.path(node)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def by_conversation(rows: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, in order; ``_kind`` puts a header row first."""
    order = [F.col("conv_id"), F.col("_kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def plain(rows: DataFrame, dropped: str | None) -> DataFrame:
    """Rows as both passes see them: ``_kind`` 1, or 2 for rows that only name their conversation."""
    gone = F.lit(False) if dropped is None else F.col(dropped)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        F.when(gone, 2).otherwise(1).alias("_kind"),
        F.col("turn").cast("long").alias("turn"),
        F.when(~gone, role).otherwise("").alias("role"),
        F.when(~gone, text).otherwise("").alias("text"),
    )


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in batches:
        yield from zip(*(column.to_pylist() for column in part.columns))


def in_batches(found: Iterator[tuple], schema: pa.Schema, rows: int = 512) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for one in found:
        kept.append(one)
        if len(kept) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def streamed(frame: DataFrame, function, ddl: str) -> DataFrame:
    """Apply a generator over rows to each partition; ``ddl`` follows the conversation's id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = StructType([frame.schema["conv_id"], *StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(function(lines(batches)), arrow)

    bounded_batches(frame.sparkSession)
    return frame.mapInArrow(run, shape)


def _audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    audit, of = None, None
    for conv_id, kind, turn, role, text in rows:
        if audit is None or conv_id != of:
            if audit is not None:
                yield of, *audit.result()
            audit, of = Audit(), conv_id
        if kind == 1:
            audit.row(turn, role, text)
    if audit is not None:
        yield of, *audit.result()


def _applied(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Follow each conversation's edits, which come as the text of its header row."""
    of, edits, at, place, seq = None, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, seq
        while at < len(edits) and edits[at] == INSERT:
            initial = EXPECTED[place]
            yield of, seq, None, ROLES[initial], "", INSERT
            at, place, seq = at + 1, STEPS[place][initial], seq + 1

    for conv_id, kind, turn, role, text in rows:
        if kind == 0:
            yield from inserted()
            of, edits, at, place, seq = conv_id, text, 0, START, 0
        elif kind == 1:
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == DELETE:
                continue
            initial = role[:1] if edit == KEEP else EXPECTED[place]
            yield conv_id, seq, turn, role if edit == KEEP else ROLES[initial], text, edit
            place, seq = STEPS[place][initial], seq + 1
    yield from inserted()


def audited(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row per conversation: its faults, and cost and initials of the cheapest edits.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; rows for which the column named ``dropped``
    is true only name their conversation.
    """
    return streamed(by_conversation(plain(rows, dropped)), _audits, STATS)


def repaired(rows: DataFrame, audits: DataFrame, dropped: str | None = None) -> DataFrame:
    """The rows of the repaired conversations with their place and edit, in order within a partition."""
    header = audits.select(
        "conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")
    )
    together = by_conversation(plain(rows, dropped).unionByName(header))
    return streamed(together, _applied, "seq long, turn long, role string, text string, edit string")


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    digest, of = None, None
    for conv_id, seq, _, role, text, _ in rows:
        if seq == 0:
            if digest is not None:
                yield of, digest.hexdigest()
            digest, of = hashlib.sha256(), conv_id
        digest.update(f"{'\n' if seq else ''}{role}:{text}".encode())
    if digest is not None:
        yield of, digest.hexdigest()


def digests(conversations: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each conversation of ``repaired``, in the order these rows have."""
    return streamed(conversations, _digests, "repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with a known fault each, as a digest of conversation and turn says; ``dropped`` rows stay as markers."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = part("role"), part("text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("_fault"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_fault") == 0).alias("dropped"),
        F.explode(times).alias("_time"),
    ).drop("_time")


SQL = r"""
with recursive bits as (
    select i::ubigint as i, 0 as k, i::ubigint as v from range(256) r(i)
    union all select i, k + 1, xor(v >> 1, case when v & 1 = 1 then 3988292384::ubigint else 0::ubigint end) from bits where k < 8
), crc as (
    select list(v order by i) as entry from bits where k = 8
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), faulty as (
    select conv_id, turn, role, text, xor(4294967295::ubigint, list_reduce(
        list_prepend(4294967295::ubigint, list_transform(range(1, length(key) + 1), lambda j: ascii(substr(key, j, 1))::ubigint)),
        lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255)::bigint + 1]))) % 20 as fault
    from keyed, crc
), damaged as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
           case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from faulty, range(case when fault = 3 then 2 else 1 end) r(time) where fault <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
           not regexp_matches(text, '[^\x20\x09-\x0D]') as blank from damaged
), judged as (
    select *, left(role, 1) as initial, not blank and row_number() over (partition by conv_id, role, text order by pos) > 1 as duplicate,
           lag(left(role, 1)) over (partition by conv_id order by pos) as before from placed
), rows as (
    select *, not blank and not duplicate and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as truncated from judged
), stats as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
           count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
           count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(pos) as n
    from rows group by conv_id
), paths as (
    select conv_id, 0::bigint as pos, {'c': 0::bigint, 'a': '', 'r': ''} as p0, {'c': 1000000000::bigint, 'a': '', 'r': ''} as p1,
           {'c': 3::bigint, 'a': 'I', 'r': 'user:'} as p2, {'c': 6::bigint, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'} as p3
    from stats
    union all
    select conv_id, pos, n0, n1, least(n2, {'c': n0.c + 3, 'a': n0.a || 'I', 'r': 'user:'},
               {'c': n1.c + 3, 'a': n1.a || 'I', 'r': n1.r || chr(10) || 'user:'}, {'c': n3.c + 3, 'a': n3.a || 'I', 'r': n3.r || chr(10) || 'user:'}) as m2,
           least(n3, {'c': m2['c'] + 3, 'a': m2['a'] || 'I', 'r': m2['r'] || chr(10) || 'assistant:'}) as m3
    from (
        select p.conv_id, w.pos, case when w.truncated then 3 else 0 end + case when w.blank or w.duplicate then 1000000000 else 0 end as more,
               case when w.initial = 's' then 0 else 1000000000 end as not_s, case when w.initial = 'u' then 0 else 1000000000 end as not_u,
               case when w.initial = 'a' then 0 else 1000000000 end as not_a, w.role || ':' || w.text as own,
               {'c': p0.c + 4, 'a': p0.a || 'D', 'r': p0.r} as n0,
               least({'c': p1.c + 4, 'a': p1.a || 'D', 'r': p1.r}, {'c': p0.c + more + not_s, 'a': p0.a || 'K', 'r': own}) as n1,
               least({'c': p2.c + 4, 'a': p2.a || 'D', 'r': p2.r},
                   {'c': p0.c + more + not_u, 'a': p0.a || 'K', 'r': own},
                   {'c': p1.c + more + not_u, 'a': p1.a || 'K', 'r': p1.r || chr(10) || own},
                   {'c': p3.c + more + not_u, 'a': p3.a || 'K', 'r': p3.r || chr(10) || own},
                   {'c': p0.c + more + 3, 'a': p0.a || 'R', 'r': 'user:' || w.text},
                   {'c': p1.c + more + 3, 'a': p1.a || 'R', 'r': p1.r || chr(10) || 'user:' || w.text},
                   {'c': p3.c + more + 3, 'a': p3.a || 'R', 'r': p3.r || chr(10) || 'user:' || w.text}) as n2,
               least({'c': p3.c + 4, 'a': p3.a || 'D', 'r': p3.r},
                   {'c': p2.c + more + not_a, 'a': p2.a || 'K', 'r': p2.r || chr(10) || own},
                   {'c': p2.c + more + 3, 'a': p2.a || 'R', 'r': p2.r || chr(10) || 'assistant:' || w.text}) as n3
        from paths p join rows w on w.conv_id is not distinct from p.conv_id and w.pos = p.pos + 1
    )
), best as (
    select s.*, least(p.p0, p.p3) as found from stats s join paths p on p.conv_id is not distinct from s.conv_id and p.pos = s.n
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(found.c, 0)::bigint as cost,
       coalesce(found.a, '') as audit, sha256(coalesce(found.r, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join best on best.conv_id is not distinct from c.conv_id
"""


@query(SQL)
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations, repairs them and digests the repaired rows."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    audits = written(audited(rows, "dropped"), "audits")
    texts = digests(repaired(rows, audits, "dropped")).withColumnRenamed("conv_id", "_of")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return audits.join(texts, F.col("conv_id").eqNullSafe(F.col("_of")), "left").select(
        *audits.columns, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
