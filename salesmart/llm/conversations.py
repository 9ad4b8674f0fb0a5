"""Repair of the turn order of conversations at least cost, by a dynamic program over runs.

After repair the roles are ``(s?(ua)+)?``. A row is a symbol: its role's initial and its fault. What a
row does to the four states of that pattern is a min-plus matrix, insertions before the row included.
Equal consecutive symbols are a run, and a run's matrix is a power: powers by squares are cached per
symbol, so a run of any length takes a few products. Costs to the end are carried backwards from run
to run; the edits are then unrolled forwards, at each step the first in ASCII order that still ends
at the least cost.

Conversations of a bounded size are solved whole, each in one task. Longer ones are dealt to ordered
segments by ranges of turns. As min-plus products are associative, each segment gives a matrix;
the segments' matrices give the costs behind each one, with which it is unrolled from every state it
may be entered in; one pass over the segments then picks what fits together. Equal rows of a long
conversation are one row with a count. The digest of a conversation is a stream over its segments.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salesmart.llm import sharedfs
from salesmart.llm.common import map_rows
from salesmart.sources.staging import stage, work_folder

#: Rows and characters up to which a conversation is solved in one piece, and of a segment.
WHOLE_ROWS, WHOLE_POINTS = 50_000, 1 << 24

#: Damage by the remainder of a row's number.
KINDS, DROP, EMPTY, UNMARK, REPEAT, TO_USER = 20, 0, 1, 2, 3, 4

RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
          "illegal bigint, cost bigint, audit string, repaired_sha256 string")
SEGMENTS = ("file string, conv_id bigint, number bigint, matrix array<bigint>, blank bigint, "
            "duplicate bigint, truncated bigint, illegal bigint, distinct bigint, first_turn bigint, "
            "last_turn bigint, first_initial string, last_initial string")

WHITE = " \t\n\v\f\r"
ENDS = ".!?"

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
STATES = 4
#: Where an inserted or renamed turn leads, and its role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Where a kept turn leads, by its initial.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: What is left to pay at the end of the rows: nothing in accepted states, else insertions.
INSERT, DELETE, RENAME, UNFINISHED = 5, 2, 1, 5
FAR = 1 << 60

Vector = tuple[int, int, int, int]


def step(symbol: str, state: int, after: Vector) -> list[tuple[str, int, int]]:
    """(initial, cost to the end, next state) of the edits of a row, in ASCII order, insertion left out."""
    found = [("D", DELETE + after[state], state)]
    if symbol[1] != "x":
        extra = UNFINISHED if symbol[1] == "t" else 0
        kept = KEPT.get(symbol[0], (None,) * STATES)[state]
        if kept is not None:
            found.append(("K", extra + after[kept], kept))
        found.append(("R", extra + RENAME + after[NEXT[state]], NEXT[state]))
    return found


def inserting(costs: list[int]) -> Vector:
    """Costs by state if turns may be inserted first; two lead back to a state of the same roles."""
    once = [min(costs[state], INSERT + costs[NEXT[state]]) for state in range(STATES)]
    return tuple(min(costs[state], INSERT + once[NEXT[state]]) for state in range(STATES))


END = inserting([0, FAR, FAR, 0])


def before(symbol: str, after: Vector) -> Vector:
    """Costs to the end before a row, from those after it."""
    return inserting([min(cost for _, cost, _ in step(symbol, state, after)) for state in range(STATES)])


Matrix = tuple[Vector, ...]
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(STATES)) for i in range(STATES))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(STATES))) for j in range(STATES))
                 for i in range(STATES))


def apply(a: Matrix, costs: Vector) -> Vector:
    return tuple(min(FAR, *(a[i][k] + costs[k] for k in range(STATES))) for i in range(STATES))


@lru_cache(maxsize=4096)
def power(symbol: str, exponent: int) -> Matrix:
    """The matrix of 2 ** ``exponent`` rows of a symbol."""
    if exponent == 0:
        columns = [before(symbol, UNIT[j]) for j in range(STATES)]
        return tuple(tuple(min(FAR, columns[j][i]) for j in range(STATES)) for i in range(STATES))
    half = power(symbol, exponent - 1)
    return product(half, half)


def powers(symbol: str, length: int) -> Iterator[Matrix]:
    return (power(symbol, bit) for bit in range(length.bit_length()) if length >> bit & 1)


def run_before(symbol: str, length: int, costs: Vector) -> Vector:
    """Costs to the end before a run of equal symbols."""
    for matrix in powers(symbol, length):
        costs = apply(matrix, costs)
    return costs


def runs_of(symbols: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """(symbol, times) with equal neighbours collapsed."""
    return [(symbol, sum(times for _, times in group))
            for symbol, group in groupby(symbols, key=itemgetter(0))]


def matrix_of(runs: list[tuple[str, int]]) -> Matrix:
    whole = UNIT
    for symbol, length in runs:
        for matrix in powers(symbol, length):
            whole = product(whole, matrix)
    return whole


def unroll(runs: list[tuple[str, int]], state: int, after: Vector, last: bool) -> tuple[int, str]:
    """The exit state, and of the cheapest edits those first in ASCII order, entered in ``state``."""
    borders = [after]
    for symbol, length in reversed(runs):
        borders.append(run_before(symbol, length, borders[-1]))
    # Letters are looked at in their order; an insertion comes after a deletion and before the rest.
    audit: list[str] = []
    for (symbol, length), costs in zip(runs, reversed(borders[:-1]), strict=True):
        inside = [costs]
        for _ in range(length - 1):
            costs = before(symbol, costs)
            inside.append(costs)
        for costs in reversed(inside):
            now = before(symbol, costs)
            while True:
                edits = [edit for edit in step(symbol, state, costs) if edit[1] == now[state]]
                deleted = bool(edits) and edits[0][0] == "D"
                if deleted or now[state] != INSERT + now[NEXT[state]]:
                    break
                audit.append("I")
                state = NEXT[state]
            initial, _, state = edits[0]
            audit.append(initial)
    if last:
        while END[state] > 0:
            audit.append("I")
            state = NEXT[state]
    return state, "".join(audit)


@lru_cache(maxsize=50_000)
def solve(symbols: tuple[str, ...]) -> tuple[int, str]:
    """Least cost and edits of a short conversation; most share their symbols with many others."""
    return solve_runs(runs_of((symbol, 1) for symbol in symbols))


def solve_runs(runs: list[tuple[str, int]]) -> tuple[int, str]:
    costs = END
    for symbol, length in reversed(runs):
        costs = run_before(symbol, length, costs)
    return costs[0], unroll(runs, 0, END, True)[1]


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """The turns that edits leave, as ``role:text``."""
    source = iter(rows)
    for edit in audit:
        if edit == "I":
            yield f"{ROLE[state]}:"
            state = NEXT[state]
            continue
        role, text = next(source)
        if edit == "R":
            role, state = ROLE[state], NEXT[state]
        elif edit == "K":
            state = KEPT[role[:1]][state]
        if edit != "D":
            yield f"{role}:{text}"


def fault_of(text: str, seen: bool) -> str:
    """The first fault that holds, by initial."""
    words = text.rstrip(WHITE)
    return "b" if not words else "d" if seen else "t" if words[-1] not in ENDS else "-"


def symbol_of(role: str, fault: str) -> str:
    return (role[:1] if role[:1] in KEPT else "-") + ("x" if fault in "bd" else fault)


def illegal(left: str | None, right: str) -> bool:
    return left is not None and left + right not in ("su", "ua", "au")


def number_of(*columns: str) -> Column:
    """The unsigned crc32 of the columns' texts between colons; a null is one space."""
    return F.crc32(F.concat_ws(":", *[
        F.coalesce(F.col(column).cast("string"), F.lit(" ")) for column in columns]))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of every row after damage; times is 0 of a dropped row."""
    kind = number_of("conv_id", "turn") % KINDS
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.when(kind == TO_USER, "user").otherwise(role).alias("role"),
        F.when(kind == EMPTY, "").when(kind == UNMARK, F.translate(text, ENDS, "")).otherwise(
            text).alias("text"),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).alias("times"))


def _whole(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The result of each conversation, from its rows in order."""
    for conv_id, group in groupby(rows, key=itemgetter(0)):
        counts = dict.fromkeys("bdt-", 0)
        turns: list[tuple[str, str]] = []
        symbols: list[str] = []
        seen: set[tuple[str, str]] = set()
        known: set[int] = set()
        wrong = 0
        for _, turn, role, text, times in group:
            for _ in range(times):
                fault = fault_of(text, (role, text) in seen)
                counts[fault] += 1
                wrong += illegal(turns[-1][0][:1] if turns else None, role[:1])
                seen.add((role, text))
                turns.append((role, text))
                symbols.append(symbol_of(role, fault))
                if turn is not None:
                    known.add(turn)
        cost, audit = solve(tuple(symbols)) if len(symbols) < 64 else solve_runs(
            runs_of((symbol, 1) for symbol in symbols))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        text = "\n".join(repaired(turns, audit, 0))
        yield (conv_id, gaps, counts["b"], counts["d"], counts["t"], wrong, cost, audit,
               hashlib.sha256(text.encode()).hexdigest())


# --- Long conversations -------------------------------------------------------------------------

class Segment(NamedTuple):
    """Consecutive distinct rows of a long conversation: how often each occurs, and if it was seen."""
    roles: list[str]
    texts: list[str]
    times: list[int]
    seen: list[bool]

    def save(self, uri: str) -> None:
        table = pa.table(dict(zip(self._fields, self, strict=True)))
        with sharedfs.open_output(uri) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)

    @classmethod
    def load(cls, uri: str) -> Segment:
        system, path = sharedfs.file_system(uri)
        with system.open_input_file(path) as source:
            table = pa.ipc.open_file(source).read_all()
        return cls(*[table.column(name).to_pylist() for name in cls._fields])

    def faults(self) -> Iterator[tuple[str, str, int]]:
        """(role, fault, times): of equal rows all but the first one of the conversation are seen."""
        for role, text, times, seen in zip(*self, strict=True):
            first = fault_of(text, seen)
            if first in "bd":
                yield role, first, times
                continue
            yield role, first, 1
            if times > 1:
                yield role, "d", times - 1

    def runs(self) -> list[tuple[str, int]]:
        return runs_of((symbol_of(role, fault), times) for role, fault, times in self.faults())

    def rows(self) -> Iterator[tuple[str, str]]:
        for role, text, times in zip(self.roles, self.texts, self.times, strict=True):
            for _ in range(times):
                yield role, text


def _segments(rows: Iterable[tuple], folder: str, limit: int) -> Iterator[tuple]:
    """Write the segments of each partition; a row of summary for each."""
    for conv_id, group in groupby(rows, key=itemgetter(0)):
        held: list[tuple] = []
        points, part = 0, 0
        for _, turn, role, text, times, seen, part in group:
            held.append((turn, role, text, times, seen))
            points += len(text)
            if points >= WHOLE_POINTS or len(held) >= limit:
                yield _segment(conv_id, part, held, folder)
                held, points = [], 0
        if held:
            yield _segment(conv_id, part, held, folder)


def _segment(conv_id: int | None, part: int, held: list[tuple], folder: str) -> tuple:
    # Named by attempt: only files of tasks that ended well are ever read.
    file = f"{folder}/{uuid.uuid4().hex}.segment"
    turns, *columns = map(list, zip(*held, strict=True))
    segment = Segment(*columns)
    segment.save(file)
    counts = dict.fromkeys("bdt-", 0)
    wrong, last = 0, None
    for role, fault, times in segment.faults():
        counts[fault] += times
        wrong += illegal(last, role[:1]) + (times - 1) * illegal(role[:1], role[:1])
        last = role[:1]
    known = [turn for turn in turns if turn is not None]
    matrix = [cost for row in matrix_of(segment.runs()) for cost in row]
    return (file, conv_id, part, matrix, counts["b"], counts["d"], counts["t"], wrong,
            len(set(known)), known[0] if known else None, known[-1] if known else None,
            segment.roles[0][:1], last)


def square(flat: list[int]) -> Matrix:
    return tuple(tuple(flat[i * STATES:(i + 1) * STATES]) for i in range(STATES))


def _behind(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Tell each segment, from the last to the first, the costs behind it; and which is the last."""
    for _, group in groupby(rows, key=itemgetter(0)):
        costs, last = END, True
        for _, file, flat in group:
            yield file, list(costs), last
            costs, last = apply(square(flat), costs), False


def _unrolled(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The edits of each segment from every state, in a file beside it, and where they lead."""
    for file, after, last in rows:
        runs = Segment.load(file).runs()
        ways = [unroll(runs, state, tuple(after), last) for state in range(STATES)]
        sharedfs.write_bytes(f"{file}.edits", "\n".join(audit for _, audit in ways).encode())
        yield file, [state for state, _ in ways]


def _joined(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The result of each long conversation; its texts pass through the digest segment by segment."""
    for conv_id, group in groupby(rows, key=itemgetter(0)):
        totals = np.zeros(4, np.int64)
        distinct, first, last, before_it = 0, None, None, None
        whole, state, audits, digest, empty = UNIT, 0, [], hashlib.sha256(), True
        for (_, file, exits, flat, *counts, turns, first_turn, last_turn,
             first_initial, last_initial) in group:
            totals += counts
            totals[3] += illegal(before_it, first_initial)
            before_it = last_initial
            distinct += turns - (last is not None and first_turn == last)
            first = first_turn if first is None else first
            last = last_turn if last_turn is not None else last
            whole = product(whole, square(flat))
            edits = sharedfs.mapped(f"{file}.edits", "u1").tobytes().decode().split("\n")[state]
            for turn in repaired(Segment.load(file).rows(), edits, state):
                digest.update((turn if empty else "\n" + turn).encode())
                empty = False
            audits.append(edits)
            state = exits[state]
        gaps = 0 if first is None else last - first + 1 - distinct
        yield (conv_id, gaps, *totals.tolist(), apply(whole, END)[0], "".join(audits),
               digest.hexdigest())


def long_conversations(rows: DataFrame, tasks: int, segment_rows: int = WHOLE_ROWS) -> DataFrame:
    """Results of conversations of any size, from their damaged rows."""
    folder = sharedfs.make_folder(f"{work_folder(rows.sparkSession)}/turns-{uuid.uuid4().hex}")
    equal = stage(rows.groupBy("conv_id", "turn", "role", "text").agg(
        F.sum("times").alias("times")).withColumn("digest", F.unhex(F.md5(
            F.concat_ws(":", F.length("role").cast("string"), "role", "text")))), "turns")
    # Only what occurs at several turns; the join can split a text that very many turns repeat.
    first = stage(equal.groupBy("conv_id", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where(
            "turns > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first"),
        "first")
    marked = equal.join(
        first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.select(*order, "times", (
        F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"))
    dealt = stage(dealt, "marked").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The parts of a partition follow each other: 2 ** 33 to a partition.
    parts = dealt.withColumn("part", F.monotonically_increasing_id())
    segments = stage(map_rows(parts, SEGMENTS, lambda: lambda rows: _segments(rows, folder, segment_rows), chunk=1),
                     "segments")
    backwards = segments.repartition(tasks, "conv_id").sortWithinPartitions(
        "conv_id", F.desc("number")).select("conv_id", "file", "matrix")
    behind = stage(map_rows(backwards, "file string, after array<bigint>, last boolean",
                            lambda: _behind), "behind")
    exits = stage(map_rows(behind.repartition(tasks, "file"), "file string, exits array<int>",
                           lambda: _unrolled, chunk=16), "exits")
    onward = segments.join(exits, "file").repartition(tasks, "conv_id").sortWithinPartitions(
        "conv_id", "number")
    return map_rows(onward.select("conv_id", "file", "exits", *segments.columns[3:]), RESULT,
                    lambda: _joined, chunk=1)


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, whole_points: int = WHOLE_POINTS,
           segment_rows: int = WHOLE_ROWS) -> DataFrame:
    """Counts of faults, cost and edits of the cheapest repair of every conversation, after damage.

    Rows stand in the order of their turn, nulls first; of one turn by role and text. A null in
    any column counts as one space: such a role is none of the known ones, such a text is blank, and
    rows without conv_id are one conversation. Roles count by their first character. Repeated rows
    are damaged alike and each stays a row, so the second one is a duplicate. A conversation all
    of whose rows are dropped has zeros, no edits and the digest of the empty text; a table without
    rows gives none. Conversations beyond ``whole_rows`` rows or ``whole_points`` characters are
    solved in segments of up to ``segment_rows`` rows, with the same result.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = damaged(rows)
    sizes = stage(turns.groupBy("conv_id").agg(
        F.sum("times").alias("rows"), F.sum(F.col("times") * F.length("text")).alias("points")), "sizes")
    is_long = (F.col("rows") > whole_rows) | (F.col("points") > whole_points)
    long = sizes.where(is_long).select(F.col("conv_id").alias("long_id"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    there = turns.where("times > 0")
    empty = sizes.where("rows = 0").select(
        "conv_id", *[F.lit(None).cast(kind).alias(name) for name, kind in turns.dtypes[1:4]],
        F.lit(0).alias("times"))
    short = there.join(long, same, "left_anti").union(empty)
    found = map_rows(
        short.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"),
        RESULT, lambda: _whole)
    if long.isEmpty():
        return found
    return found.union(long_conversations(there.join(long, same, "left_semi"), tasks, segment_rows))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(
    list_prepend(n::BIGINT, range(0, 8)::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
named AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(
    coalesce(conversations.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS bytes
  FROM conversations JOIN convs ON convs.conv_id IS NOT DISTINCT FROM conversations.conv_id),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(0, length(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(i)),
placed AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged),
faults AS (
  SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY p) AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault
  FROM placed),
counts AS (
  SELECT c, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c),
-- States: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's.
inserted(state, onward, cost, letters) AS (VALUES
  (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
  (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'),
  (0, 3, 10, 'II'), (1, 3, 10, 'II'), (2, 2, 10, 'II'), (3, 3, 10, 'II')),
edits(letter, state, initial, onward, cost) AS (VALUES
  ('D', 0, NULL, 0, 2), ('D', 1, NULL, 1, 2), ('D', 2, NULL, 2, 2), ('D', 3, NULL, 3, 2),
  ('R', 0, NULL, 2, 1), ('R', 1, NULL, 2, 1), ('R', 2, NULL, 3, 1), ('R', 3, NULL, 2, 1),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)),
moves AS (
  SELECT inserted.state, letter, initial, edits.onward, inserted.cost + edits.cost AS cost,
    letters || letter AS letters
  FROM inserted JOIN edits ON edits.state = inserted.onward),
paths(c, p, state, best) AS (
  SELECT c, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': ''} FROM convs
  UNION ALL
  SELECT paths.c, paths.p + 1, moves.onward, min({
    'cost': best.cost + moves.cost + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END,
    'audit': best.audit || letters})
  FROM paths JOIN faults ON faults.c = paths.c AND faults.p = paths.p + 1
  JOIN moves ON moves.state = paths.state
    AND (letter = 'D' OR fault NOT IN ('b', 'd')) AND (letter <> 'K' OR moves.initial = faults.initial)
  GROUP BY paths.c, paths.p, moves.onward),
ends AS (
  SELECT paths.c, min({'cost': best.cost + inserted.cost, 'audit': best.audit || letters}) AS best
  FROM paths LEFT JOIN counts ON counts.c = paths.c
  JOIN inserted ON inserted.state = paths.state AND inserted.onward IN (0, 3)
  WHERE p = coalesce(n, 0) GROUP BY paths.c),
letters AS (
  SELECT c, i, substr(best.audit, i, 1) AS letter FROM ends, unnest(range(1, length(best.audit) + 1)) AS t(i)),
numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS p, count(*) FILTER (letter <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING)),
left_over AS (
  SELECT numbered.c, i, place, letter, role, initial, text,
    max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY numbered.c) AS led
  FROM numbered LEFT JOIN faults ON faults.c = numbered.c AND faults.p = numbered.p AND letter <> 'I'
  WHERE letter <> 'D'),
texts AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole
  FROM left_over GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost, best.audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM convs JOIN ends ON ends.c = convs.c LEFT JOIN counts ON counts.c = convs.c
LEFT JOIN texts ON texts.c = convs.c
"""
