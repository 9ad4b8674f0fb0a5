"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from salesmart.llm import conversations

LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\v\f\r"


def accepted(roles):
    if not roles:
        return True
    pairs = roles[1:] if roles[0] == "s" else roles
    return bool(pairs) and pairs == "ua" * (len(pairs) // 2)


def can_go_on(roles):
    """Whether more turns can make the roles acceptable."""
    return any(accepted(roles + more) for more in ("", "a", "ua"))


def cheapest(rows, price=5):
    """(cost, audit, turns) by searching all edits, the cheapest and then the first ones first.

    Two repairs that are equal in what still matters (row, last role, whether there are turns) are one.
    """
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, at, roles, turns = heapq.heappop(queue)
        key = (at, roles[-1:] , len(roles) > 0)
        if at == len(rows) and accepted(roles):
            return cost, audit, turns
        if key in done:
            continue
        done.add(key)

        def go(more_cost, letter, taken, role, text):
            more = roles + role[:1]
            if can_go_on(more):
                kept = turns + ((role, text),) if role else turns
                heapq.heappush(queue, (cost + more_cost, audit + letter, at + taken, more, kept))

        for role in ("user", "assistant"):
            go(price, "I", 0, role, "")
        if at < len(rows):
            role, text, fault = rows[at]
            go(2, "D", 1, "", "")
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role:
                    go(extra, "K", 1, role, text)
                for other in ("user", "assistant"):
                    go(extra + 1, "R", 1, other, text)
    raise AssertionError


def plain(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        number = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if number == 1:
            text = ""
        if number == 2:
            text = "".join(x for x in text if x not in ".!?")
        if number == 4:
            role = "user"
        groups[conv].extend([(turn, role, text)] * {0: 0, 3: 2}.get(number, 1))
    found = []
    for conv, turns in groups.items():
        turns.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
        seen, judged = set(), []
        for _, role, text in turns:
            words = text.strip(WHITE)
            fault = ("blank" if not words else "duplicate" if (role, text) in seen
                     else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
            judged.append((role, text, fault))
        known = {turn for turn, _, _ in turns if turn is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        faults = [fault for _, _, fault in judged]
        wrong = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(turns, turns[1:]))
        cost, audit, kept = cheapest(judged)
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        found.append((conv, gaps, faults.count("blank"), faults.count("duplicate"),
                      faults.count("truncated"), wrong, cost, audit,
                      hashlib.sha256(text.encode()).hexdigest()))
    return found


def order(rows):
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))


def made(seed, count=150, longest=14):
    """Conversations with runs of one role, gaps, nulls, blanks, repeats and odd roles."""
    draw = random.Random(seed)
    texts = ["Yes.", "No", "a b!", " \t", "", None, "Well? ", "two\nlines", "é。", "So.\x1c"]
    rows = []
    for key in range(count):
        conv = draw.choice([key, key, key, key, None]) if key % 20 == 0 else key
        turn = 0
        for _ in range(draw.randrange(longest)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            for _ in range(draw.choice([1, 1, 1, 1, 2, 4])):
                text = draw.choice(texts + [f"text {turn}.", f"word {turn}"] * 6)
                rows.append((conv, draw.choice([turn] * 12 + [None, 3]), role, text))
                turn += draw.choice([1, 1, 1, 2])
    draw.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, **limits):
    got = [tuple(row) for row in conversations.repair(
        spark.createDataFrame(rows, SCHEMA), **limits).collect()]
    want = plain(rows)
    for a, b in zip(order(got), order(want), strict=True):
        assert a == b
    return want


def test_equals_search(spark):
    want = check(spark, made(1))
    assert {letter for row in want for letter in row[7]} == set("DKR")


@pytest.mark.parametrize("price", [1, 2])
def test_cheap_insertions(monkeypatch, price):
    """At its own price an insertion never pays; at others it does, also over segments."""
    monkeypatch.setattr(conversations, "INSERT", price)
    monkeypatch.setattr(conversations, "END", conversations.inserting(
        [0, conversations.FAR, conversations.FAR, 0]))
    conversations.power.cache_clear()
    draw = random.Random(price)
    letters = set()
    for _ in range(400):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), "x.",
                 draw.choice(["", "", "", "blank", "truncated"])) for _ in range(draw.randrange(9))]
        symbols = [conversations.symbol_of(role, {"": "-", "blank": "b", "truncated": "t"}[fault])
                   for role, _, fault in rows]
        runs = conversations.runs_of((symbol, 1) for symbol in symbols)
        cost, audit, _ = cheapest(rows, price)
        assert conversations.solve_runs(runs) == (cost, audit)
        letters |= set(audit)
        cut = draw.randrange(len(symbols) + 1)
        first, second = (conversations.runs_of((symbol, 1) for symbol in part)
                         for part in (symbols[:cut], symbols[cut:]))
        behind = conversations.apply(conversations.matrix_of(second), conversations.END)
        state, start = conversations.unroll(first, 0, behind, False)
        assert start + conversations.unroll(second, state, conversations.END, True)[1] == audit
    conversations.power.cache_clear()
    assert letters == set("DIKR")


@pytest.mark.parametrize("limit, size", [(3, 2), (0, 5), (10, 1)])
def test_long_ones_in_segments(spark, limit, size):
    """Segments of few rows, some of a conversation in one partition, some over several."""
    rows = made(limit + 2, 40, 20)
    check(spark, rows + rows[:30], whole_rows=limit, segment_rows=size)


def test_one_conversation_of_repeated_rows(spark):
    """Long runs of a few symbols, and one row many times over."""
    rows = [(1, k, "user", f"{k}.") for k in range(150)]
    rows += [(1, 200 + k, "assistant", "same.") for k in range(100)]
    rows += [(1, 400, "user", "copy.")] * 300 + [(1, 500, "assistant", "end")]
    want = check(spark, rows, whole_rows=50, segment_rows=7)
    assert want == plain(rows)
    check(spark, rows)


def test_powers_are_steps():
    draw = random.Random(3)
    for symbol in [role + fault for role in "sua-" for fault in "-tx"]:
        for length in (1, 2, 5, 37, 200):
            costs = tuple(draw.randrange(30) for _ in range(4))
            stepped = conversations.inserting(list(costs))
            by_power = conversations.run_before(symbol, length, stepped)
            for _ in range(length):
                stepped = conversations.before(symbol, stepped)
            assert by_power == stepped


def test_odd_tables(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None), (1, None, "user", "x" * 200_000), (2, 0, "", "a."), (2, 0, "", "a.")]
    extra = spark.createDataFrame(
        [(*row, 1, "k", 2.0) for row in rows], SCHEMA + ", times int, number string, file double")
    got = [tuple(row) for row in conversations.repair(extra).collect()]
    assert order(got) == order(plain(rows))
