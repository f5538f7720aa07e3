"""Conversation repair against a search over all edits, in blocks so small that conversations cross them."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest

from fieldloom.llm import conversation_repair as cr
from fieldloom.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, seq string, cost string"
BLANKS = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(told.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def step(state, initial):
    """The grammar as an automaton: '' start, 's', 'u', 'a'; None where it ends."""
    return initial if initial and state + initial in ("s", "u", "su", "ua", "au") and not (state == "" and initial == "a") else None


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, by uniform-cost search over (place, state)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            to = step(state, role[0])
            if to:
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*lines, f"{role}:")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] not in (1, 2):
                more = 3 if faults[at] == 3 else 0
                to = step(state, role[:1])
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
                for given in ("user", "assistant"):
                    to = step(state, given[0])
                    if to:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, to, (*lines, f"{given}:{text}")))
    raise AssertionError("no way")


def brute(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in brute_damage(rows):
        convs[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest([(r, t) for _, r, t in own], faults)
        out[conv] = (gaps, *(faults.count(i) for i in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "No", "", " \t", None, "What?\n", "Long " * 300 + "end.", "Fine! ", "a\x1f", "é.", "dots... and more"]
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, rng.randint(0, most), rng.randint(0, most)])
            rows += [(conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.randint(0, 999)}.")] * rng.choice([1, 1, 1, 2])
    return rows


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize(("seed", "convs", "most", "bits"), [(1, 40, 9, 12), (2, 25, 12, 1), (3, 1, 300, 3), (4, 30, 6, 0)])
def test_repair_equals_search_over_all_edits(spark, seed, convs, most, bits):
    rows = random_rows(seed, convs, most)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert got(cr.audit_conversations(df, block_bits=bits)) == brute(rows)


def test_rebuilt_turns_read_as_the_grammar_asks(spark):
    rows = random_rows(7, 30, 10)
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    found = cr.repair_conversations(turns, block_bits=2)
    by = collections.defaultdict(list)
    for r in found.turns.collect():
        by[r["conv"]].append(r)
    audits = {r["conv"]: r["audit"] for r in found.report.collect()}
    assert set(audits) == {r[0] for r in rows}
    for conv, audit in audits.items():
        own = sorted(by[conv], key=lambda r: r["seq"])
        initials = "".join(r["role"][0] for r in own)
        assert initials == "" or initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert "".join(r["edit"] for r in own) == audit.replace("D", "")
        assert all((r["turn"] is None and r["text"] == "") for r in own if r["edit"] == "I")


def test_empty_table_and_conversation_without_turns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.audit_conversations(df).count() == 0
    found = cr.repair_conversations(df.select(df["conv_id"].alias("conv"), "turn", "role", "text"))
    assert found.report.count() == 0 and found.turns.count() == 0
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(conv, 0, "user", "gone", None, None)], SCHEMA)
    assert got(cr.audit_conversations(one)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_crosses_blocks_and_partitions(spark):
    rows = [(0, i, "user" if i % 3 else "assistant", f"text {i}." if i % 7 else "text") for i in range(5000)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(4)
    assert got(cr.audit_conversations(df, block_bits=6)) == got(cr.audit_conversations(df, block_bits=14))


def test_texts_of_any_length(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, 0, "user", long + "end.", "", ""), (1, 1, "assistant", long, "", "")], SCHEMA)
    assert got(cr.audit_conversations(df)) == brute([(1, 0, "user", long + "end."), (1, 1, "assistant", long)])


def test_query_has_sql():
    assert "op12_conversation_repair" in registry.ORACLE_SQL
