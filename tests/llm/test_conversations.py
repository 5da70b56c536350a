"""Conversation repair against all edits of small conversations, and against a plain forward search of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import conversations
from tidemark.llm.conversations import damaged, repair, repaired_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, audit string"
TEXTS = ["Hi.", "What now?", "no end", "  ", "", None, "Hi.", "wait!  \n", "a.b", " ", "end.\u0085"]
ROLES = ["user", "assistant", "system", "tool", None, ""]
WHITE = " \t\n\x0b\f\r"


def faults(rows):
    """(role, text, fault) of sorted rows."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def all_edits(rows, most=3):
    """Least (cost, audit, lines) by trying every edit of every row and every place of up to ``most`` inserted turns."""
    best = None
    for inserts in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            for names in itertools.product(("user", "assistant"), repeat=inserts):
                for edits in itertools.product(("D", "K", "user", "assistant"), repeat=len(rows)):
                    cost, audit, lines = 5 * inserts, "", []
                    for i in range(len(rows) + 1):
                        for place, name in zip(places, names):
                            if place == i:
                                audit, lines = audit + "I", [*lines, (name, "")]
                        if i == len(rows):
                            break
                        role, text, fault = rows[i]
                        if edits[i] != "D" and fault in ("blank", "duplicate"):
                            cost = 10**9
                        cost += {"D": 2, "K": 0}.get(edits[i], 1) + (5 if edits[i] != "D" and fault == "truncated" else 0)
                        audit += edits[i] if edits[i] in "DK" else "R"
                        if edits[i] != "D":
                            lines = [*lines, (role if edits[i] == "K" else edits[i], text)]
                    if cost < 10**9 and all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)):
                        best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
    return best


def forward(rows):
    """Least (cost, audit, lines) by keeping the least of each state, row by row."""
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    fit = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    least = {"": (0, "", [])}

    def put(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                put(states, fit[q][0], (cost + 5, audit + "I", [*lines, (fit[q], "")]))
        return states

    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, lines) in inserted(dict(least)).items():
            put(after, q, (cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                put(after, fit[q][0], (cost + 1 + more, audit + "R", [*lines, (fit[q], text)]))
                if (q, role[:1]) in keep:
                    put(after, keep[q, role[:1]], (cost + more, audit + "K", [*lines, (role, text)]))
        least = after
    return min((v for k, v in inserted(least).items() if k in ("", "a")), key=lambda v: v[:2])


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def plain(rows, best):
    """The report of one conversation's rows (turn, role, text) and the hash of its repair."""
    rows = in_order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    found, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    count = lambda kind: sum(f == kind for _, _, f in found)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = best(found)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def hurt(rows):
    """The contract's damage of (conv, turn, role, text) rows."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def conversation(rng, n):
    """Mostly alternating turns, with null and repeated turn numbers, odd roles and odd texts."""
    rows = []
    for i in range(n):
        role = ROLES[i % 2] if rng.random() < 0.7 else rng.choice(ROLES)
        text = f"Turn {rng.randrange(n * 2)}." if rng.random() < 0.6 else rng.choice(TEXTS)
        rows.append((rng.choice([i, i, i, i, None, 0, 2 * i]), role, text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(3)


def as_rows(report, hashes):
    hashes = {r.conv: r.sha256 for r in hashes.collect()}
    nothing = hashlib.sha256().hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv, nothing)) for r in report.collect()}


def test_repair_equals_all_edits(spark):
    rng = random.Random(5)
    rows = {i: conversation(rng, 1 + i % 3) for i in range(60)}
    rows |= {100: [(0, "system", "Be kind.")], 101: [(0, "user", "A?"), (0, "user", "A?")], 102: [(0, "assistant", "Yes.")], 103: [(1, "", "Yes.")]}
    report, turns = repair(table(spark, [(i, *r) for i, some in rows.items() for r in some]))
    got = as_rows(report, conversations.conversation_hashes(turns))
    assert got == {i: plain(some, all_edits) for i, some in rows.items()}


@pytest.mark.parametrize("block_rows", [1 << 17, 40])
def test_repair_of_long_conversations_over_blocks(spark, block_rows):
    rng = random.Random(6)
    rows = {i: conversation(rng, n) for i, n in enumerate([300, 3, 1, 200, 2, 7, 30])}
    rows[None] = conversation(rng, 50)
    rows[9] = [(4, "user", "Hi.")] * 90 + [(5, "assistant", "Yes.")] * 3
    report, turns = repair(table(spark, [(i, *r) for i, some in rows.items() for r in some]), block_rows=block_rows)
    got = as_rows(report, conversations.conversation_hashes(turns))
    assert got == {i: plain(some, forward) for i, some in rows.items()}


def test_damage_and_whole_query(spark):
    rng = random.Random(7)
    rows = [(i, *r) for i in range(120) for r in conversation(rng, rng.randint(1, 9))]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "All of it goes."), (None, None, None, None), (None, 1, "user", "A very long text. " * 5000)]
    found = hurt(rows)
    assert sorted(map(repr, found)) == sorted(repr((r.conv, r.turn, r.role, r.text)) for r in damaged(table(spark, rows)).collect() for _ in range(r.copies))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repaired_conversations(table(spark, rows), block_rows=100).collect()}
    want = {i: plain([r[1:] for r in found if r[0] == i], forward) for i in {r[0] for r in rows}}
    assert want[gone][:7] == (0, 0, 0, 0, 0, 0, "")
    assert got == want


def test_without_rows(spark):
    none = table(spark, [(1, 0, "user", "x")]).limit(0)
    assert repaired_conversations(none).count() == 0
    assert [c for c, _ in repaired_conversations(none).dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
