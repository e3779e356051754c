"""Conversation repair: rows, edits and role grammar as weighted finite-state machines, composed lazily, cheapest path first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, table

SPACE = r"[\x20\x09-\x0D]"
INSERT, REROLE, DELETE, TRUNCATED_KEPT = 3, 3, 4, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"u": "user", "a": "assistant"}
# Grammar (s?(ua)+)? as an acceptor: 0 nothing yet, 1 after s, 2 after u, 3 after a. Only the user or assistant role that
# the grammar expects next can be inserted or given, so no two arcs of one state carry the same edit.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTED = "uuau"
ACCEPTING = (0, 3)
NEVER = float("inf")
LEGAL = ("su", "ua", "au")
BATCH = 4096

EDITS = "conv_id {0}, position long, edit string, role string, text string, fault int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DIGESTS = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 removes
    its [.!?], 3 repeats it, 4 makes it the user's. A null role or text is one space, as is a null number in the key."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("kind", F.explode(F.array_repeat("kind", F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind")


@lru_cache(maxsize=None)
def arcs(state: int, initial: str, fault: int) -> tuple[tuple[str, int, int], ...]:
    """Arcs (edit, cost, next state) that consume a row: the edit transducer composed with the grammar, for one state."""
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        kept = TRUNCATED_KEPT if fault == TRUNCATED else 0
        if (state, initial) in GRAMMAR:
            found.append(("K", kept, GRAMMAR[state, initial]))
        found.append(("R", REROLE + kept, GRAMMAR[state, EXPECTED[state]]))
    return tuple(found)


def with_inserts(costs: list, edits: list) -> None:
    """Relax the inserting arcs inside one layer. Costs are positive, so one way round the pair 2, 3 is enough, and 0 and 1 follow."""
    pair = [(costs[s], edits[s], costs[5 - s]) for s in (2, 3)]
    for state, (cost, edit, other) in zip((2, 3), pair, strict=True):
        costs[state], edits[state] = min((cost, edit), (other + INSERT, "I"))
    for state in (0, 1):
        costs[state], edits[state] = min((costs[state], edits[state]), (costs[2] + INSERT, "I"))


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and edits of the cheapest path, of equal ones that with the least edit string.

    States (row, grammar state) are met in reverse topological order. As the arcs of a state carry different edits, the
    lexicographic weight (cost, edits) is least where (cost, first edit) is, so a row keeps four edits and no strings.
    """
    costs, edits = [0 if s in ACCEPTING else NEVER for s in range(4)], ["", "~", "~", ""]
    with_inserts(costs, edits)
    layers = ["".join(e or "." for e in edits)]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        best = [min((cost + costs[then], edit) for edit, cost, then in arcs(s, initial, fault)) for s in range(4)]
        costs, edits = [c for c, _ in best], [e for _, e in best]
        with_inserts(costs, edits)
        layers.append("".join(edits))
    state, row, path = 0, 0, []
    total = costs[0]
    while (edit := layers[-1 - row][state]) != ".":
        path.append(edit)
        if edit in "IR":
            state = GRAMMAR[state, EXPECTED[state]]
        elif edit == "K":
            state = GRAMMAR[state, initials[row]]
        row += edit != "I"
    return int(total), "".join(path)


class Conversation:
    """One conversation on its way through a task: a character and a byte a row first, its texts one by one after that."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.faults, self.turns, self.last, self.audit = conv_id, [], bytearray(), [], None, None

    def note(self, turn, initial, fault, digest):
        """A row without its text."""
        same = self.last == (turn, digest)
        self.initials.append(initial or "-")
        self.faults.append(DUPLICATE if same and fault != BLANK else fault)
        self.last = (turn, digest)
        if turn is not None:
            self.turns = [self.turns[0] if self.turns else turn, turn, (self.turns[2] if self.turns else 0) + (not self.turns or turn != self.turns[1])]

    def solved(self) -> tuple:
        """The row that heads a conversation's edits."""
        initials = "".join(self.initials)
        cost, self.audit = cheapest(initials, bytes(self.faults))
        self.state = self.row = self.at = 0
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        illegal = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        counts = [self.faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return (self.conv_id, 0, None, None, None, None, gaps, *counts, illegal, cost, self.audit)

    def _edit(self, edit, role, text, fault):
        self.at += 1
        if edit == "K":
            self.state = GRAMMAR[self.state, role[:1]]
        elif edit != "D":
            expected = EXPECTED[self.state]
            self.state, role = GRAMMAR[self.state, expected], ROLES[expected]
        kept = (None, None) if edit == "D" else (role, text)
        return (self.conv_id, self.at, edit, *kept, fault, None, None, None, None, None, None, None)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._edit("I", None, "", None)

    def edited(self, role, text) -> Iterator[tuple]:
        yield from self.inserted()
        yield self._edit(self.audit[self.at], role, text, self.faults[self.row])
        self.row += 1


def edits_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edit rows of records sorted by conversation and phase: its id, its rows without texts, its rows with texts."""

    def rows():
        now = None
        for batch in batches:
            for conv_id, phase, turn, initial, fault, digest, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if phase == 0:
                    if now:
                        yield from [now.solved()] if now.audit is None else []
                        yield from now.inserted()
                    now = Conversation(conv_id)
                elif phase == 1:
                    now.note(turn, initial, fault, digest)
                else:
                    if now.audit is None:
                        yield now.solved()
                    yield from now.edited(role, text)
        if now:
            yield from [now.solved()] if now.audit is None else []
            yield from now.inserted()

    yield from batched(rows(), schema)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
        if held and (row is None or len(held) == BATCH or size > 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0


def digests_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edit rows, which come together and in order."""

    def rows():
        head = None
        for batch in batches:
            for conv_id, position, _, role, text, _, *stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if head:
                        yield (*head, digest.hexdigest())
                    head, digest, joint = (conv_id, *stats), hashlib.sha256(), ""
                elif role is not None:
                    digest.update(f"{joint}{role}:{text}".encode())
                    joint = "\n"
        if head:
            yield (*head, digest.hexdigest())

    yield from batched(rows(), schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edit rows of every conversation of `rows` (conv_id, turn, role, text) and of every conv_id of `ids`.

    Position 0 heads a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit; the other columns are null.
    Positions from 1 are its edits in order: edit (K, R, D, I), role and text after it (null where deleted), fault (0 none,
    1 blank, 2 duplicate, 3 truncated; null for inserted rows). So the rows with a role, by position, are the repaired
    conversation. Rows go by turn, nulls first, ties by role, then by the digest of role and text; equal rows are
    repetitions. A null role or text is one space; an empty role fits no grammar; rows of null conv_id are one
    conversation; other columns are ignored; empty tables give no rows. Texts of any length pass one by one.

    Whether a row repeats an earlier one is found by partial aggregates and a join of digests, which can be split where one
    conversation is hot. A conversation then passes one task as a sorted stream: first its rows without texts, some
    bytes a row, then, the path known, its texts. Nothing larger than its audit is held.
    """
    spark = rows.sparkSession
    conv, turn_type = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType
    part = lambda name: F.coalesce(F.col(name), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), TRUNCATED).otherwise(FINE)
    noted = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "digest", "role")
    again = noted.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
    again = again.agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("untimed")).filter("n > 1").drop("n")
    noted = noted.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    earlier = F.coalesce(F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first"))), F.lit(False))
    noted = noted.withColumn("fault", F.when(earlier & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")))
    known = rows.select("conv_id") if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = known.distinct().select("conv_id", F.lit(0).alias("phase"), none(turn_type, "turn"), none("string", "initial"), none("int", "fault"), none("binary", "digest"), none("string", "role"), none("string", "text"))
    notes = noted.select("conv_id", F.lit(1).alias("phase"), "turn", "initial", "fault", "digest", "role", none("string", "text"))
    texts = rows.select("conv_id", F.lit(2).alias("phase"), "turn", none("string", "initial"), none("int", "fault"), "digest", "role", "text")
    records = heads.unionByName(notes).unionByName(texts).repartition("conv_id")
    records = records.sortWithinPartitions("conv_id", "phase", F.asc_nulls_first("turn"), "role", "digest")
    return _mapped(spark, records, edits_of, EDITS.format(conv))


def _mapped(spark: SparkSession, df: DataFrame, by, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    return df.mapInArrow(lambda batches: by(batches, schema), ddl)


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, the head's columns and repaired_sha256 (of the repaired "role:text", joined by newlines) from repair()'s rows.

    `edits` must come from repair() without a shuffle in between: a conversation's rows are read together and in order.
    """
    return _mapped(edits.sparkSession, edits, digests_of, DIGESTS.format(edits.schema["conv_id"].dataType.simpleString()))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return digests(repair(damaged(given), given))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}


def _layer(state: int) -> str:
    """SQL of the least (cost, audit, repaired) among the edits of one row in one grammar state."""
    expected = EXPECTED[state]
    after = f"p.b{GRAMMAR[state, expected]}"
    kept = " ".join(f"WHEN r.initial = '{i}' THEN p.b{n}" for (s, i), n in GRAMMAR.items() if s == state)
    keep = f"CASE {kept} END"
    free = "r.fault IN (0, 3)"
    extra = "CASE WHEN r.fault = 3 THEN 3 ELSE 0 END"
    line = lambda role, tail: f"list_prepend({role} || ':' || r.text, {tail})"
    return f"""list_min(list_filter([{{'c': p.b{state}.c + 4, 'a': 'D' || p.b{state}.a, 't': p.b{state}.t}},
      CASE WHEN {free} THEN {{'c': ({keep}).c + {extra}, 'a': 'K' || ({keep}).a, 't': {line("r.role", f"({keep}).t")}}} END,
      CASE WHEN {free} THEN {{'c': {after}.c + 3 + {extra}, 'a': 'R' || {after}.a, 't': {line(f"'{ROLES[expected]}'", f"{after}.t")}}} END],
      lambda x: x IS NOT NULL AND x.c IS NOT NULL))"""


def _insert(name: str, state: int, then: str) -> str:
    role = ROLES[EXPECTED[state]]
    return f"list_min([{name}, {{'c': {then}.c + 3, 'a': 'I' || {then}.a, 't': list_prepend('{role}:', {then}.t)}}])"


ORACLE_SQL = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS before
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text))),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM seen),
start AS (SELECT DISTINCT conv_id, n, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b0, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} AS b1,
    {{'c': 3, 'a': 'I', 't': ['assistant:']}} AS b2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b3 FROM r),
path AS (SELECT conv_id, n + 1 AS i, b0, b1, b2, b3 FROM start
  UNION ALL SELECT conv_id, i, {_insert("d0", 0, "b2")}, {_insert("d1", 1, "b2")}, b2, b3 FROM (
    SELECT conv_id, i, d0, d1, {_insert("d2", 2, "d3")} AS b2, {_insert("d3", 3, "d2")} AS b3 FROM (
      SELECT p.conv_id, r.i, {_layer(0)} AS d0, {_layer(1)} AS d1, {_layer(2)} AS d2, {_layer(3)} AS d3
      FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1))),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit,
  sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN path p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 1"""
}
