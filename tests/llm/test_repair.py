import hashlib
import itertools
import random
import re
import zlib

import pytest

from cadentia.llm import repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, cost string, block string, rank string"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_force(rows, faults):
    """All edit strings by breadth over whole sequences: cheapest, then ASCII-least, whose initials match the pattern."""
    best = None
    n = len(rows)

    def go(i, cost, audit, initials, out, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == n and re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
        if run < 2:
            for name in ("user", "assistant"):
                go(i, cost + 5, audit + "I", initials + name[0], [*out, name + ":"], run + 1)
        if i < n:
            role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", initials, out, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if role[:1]:
                    go(i + 1, cost + more, audit + "K", initials + role[0], [*out, f"{role}:{text}"], 0)
                for name in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", initials + name[0], [*out, f"{name}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    return best


def by_states(rows, faults):
    """The same by dynamic programming from the end, for long conversations."""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    want = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    least = {s: (0, "", []) for s in (0, 3)}

    def with_inserts(table):
        for _ in range(2):
            for s in range(4):
                t, name = want[s]
                if t in table:
                    c, a, o = table[t]
                    one = (c + 5, "I" + a, [name + ":", *o])
                    if s not in table or one[:2] < table[s][:2]:
                        table[s] = one
        return table

    table = with_inserts(dict(least))
    for (role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for s in range(4):
            ways = []
            if s in table:
                ways.append((table[s][0] + 2, "D" + table[s][1], table[s][2]))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                for e, cost, t, name in [("K", more, keep[s].get(role[:1]), role), ("R", 1 + more, *want[s])]:
                    if t in table:
                        ways.append((table[t][0] + cost, e + table[t][1], [f"{name}:{text}", *table[t][2]]))
            if ways:
                now[s] = min(ways)
        table = with_inserts(now)
    return table[0]


def plain(conversations):
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in rows if t is not None}
        own = [(r, t) for _, r, t in rows]
        faults = plain_faults(own)
        cost, audit, out = by_states(own, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def some_rows(rng, n, roles=("system", "user", "assistant", "tool", "", None)):
    return [(rng.choice([*range(n), None]), rng.choice(roles), rng.choice(["Good.", "cut off", "", None, "  ", "Why?\n", "Other!", f"own {rng.random()}."])) for _ in range(n)]


def test_search_against_all_edit_strings():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(r or " ", t or " ") for _, r, t in some_rows(rng, rng.randrange(0, 5))]
        faults = plain_faults(rows)
        want = brute_force(rows, faults)
        assert by_states(rows, faults) == want
        kinds = [(r[:1], repair.DOOMED if f in ("blank", "duplicate") else repair.TRUNCATED if f else repair.SOUND) for (r, _), f in zip(rows, faults)]
        ways = [w[:2] for end in (repair.NOTHING, repair.ASSISTANT) for w in repair.cheapest(kinds, (repair.NOTHING,), (end,)).values()]
        assert min(ways) == want[:2] == repair.cheapest(kinds, (repair.NOTHING,), (repair.NOTHING, repair.ASSISTANT))[repair.NOTHING][:2]


@pytest.mark.parametrize("block", [32, 3, 1])
def test_repair_against_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    data = [(c, *r) for c in [*range(40), None] for r in some_rows(rng, rng.randrange(0, 9))]
    data += [(100, k, rng.choice(["user", "assistant"]), rng.choice(["Fine.", "Yes!", f"{k}.", "cut"])) for k in range(150)]
    data += [(101, 5, "user", "Same.")] * 40 + [(102, None, None, None), (103, 1, "system", "Only."), (104, 1, "assistant", "Long " * 20_000 + ".")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], CONVERSATIONS).repartition(5)
    got = {r.conv_id: tuple(r) for r in repair.repair_conversations(df).collect()}
    assert got == {r[0]: r for r in plain(data)}


def test_repaired_rows_dealt_by_block(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    rng = random.Random(9)
    data = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut", f"{k}."])) for k in range(60)]
    rows = repair.ordered(spark.createDataFrame([(*r, "", "", "") for r in data], CONVERSATIONS))
    edits = repair.plan(repair.faults(rows))
    out = sorted(repair.repair(rows, edits).collect(), key=lambda r: (r.block, r.step))
    audit = "".join(e.audit for e in sorted(edits.filter("block IS NOT NULL").collect(), key=lambda e: e.block))
    assert "".join(r.edit for r in out) == audit.replace("D", "")
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in out))


def test_damage_and_nothing(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repair_conversations(df).count() == 0
    data = [(c, t, "assistant", "One. Two!") for c in range(60) for t in (0, 1, None)]
    got = sorted((r.conv_id, r.turn is not None, r.turn or 0, r.role, r.text) for r in repair.damage(spark.createDataFrame([(*r, "", "", "") for r in data], CONVERSATIONS)).collect())
    want = []
    for c, t, role, text in data:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "One Two" if kind == 2 else text
        want += [(c, t is not None, t or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)
