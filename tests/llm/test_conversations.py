"""Repair of conversations against a search over all edits, and in blocks of few rows against blocks of many."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest

from barline.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, faults string"


def by_search(initials, faults):
    """Least (cost, audit) over all edits, with at most two insertions before each row and at the end."""
    best = None
    step = {c.FINE: "DKR", c.CUT: "DKR", c.BLANK: "D", c.AGAIN: "D"}
    for edits in product(*[step[f] for f in faults]):
        for ins in product(range(3), repeat=len(edits) + 1):
            audit, said, cost = "", "", 0
            for k, n in enumerate(ins):
                for _ in range(n):
                    role = "a" if said[-1:] == "u" else "u"
                    audit, said, cost = audit + "I", said + role, cost + 2
                if k < len(edits):
                    audit += edits[k]
                    cost += {"D": 3, "K": 0, "R": 2}[edits[k]] + (faults[k] == c.CUT and edits[k] != "D")
                    said += {"D": "", "K": initials[k] or "?", "R": "a" if said[-1:] == "u" else "u"}[edits[k]]
            if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_edits():
    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(0, 5)
        initials, faults = [r.choice(["s", "u", "u", "a", "a", "x", ""]) for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        cost, audit, end = c.cheapest(initials, faults)
        assert (cost, audit + c.ENDS[end]) == by_search(initials, faults)


def test_crossings_agree_with_the_search():
    r = random.Random(9)
    for _ in range(60):
        n = r.randrange(1, 9)
        initials, faults = [r.choice("suuaax") for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        costs = c.crossing(initials, faults)
        for entry in range(4):
            ends = [r.randrange(0, 6) for _ in range(4)]
            assert c.cheapest(initials, faults, entry, ends)[0] == min(costs[4 * entry + t] + ends[t] for t in range(4))


def plainly(rows):
    """conv_id -> the whole summary, row by row."""
    groups = {}
    for i, t, role, text in rows:
        own = groups.setdefault(i, [])
        name = f"{' ' if i is None else i}:{' ' if t is None else t}"
        slot, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if slot == 1 else re.sub("[.!?]", "", text) if slot == 2 else text
        own += [(t is not None, t or 0, "user" if slot == 4 else role, text)] * (0 if slot == 0 else 2 if slot == 3 else 1)
    out = {}
    for i, own in groups.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            told = text.rstrip(c.SPACE)
            faults.append(c.BLANK if not told else c.AGAIN if (role, text) in seen else c.FINE if told[-1] in ".!?" else c.CUT)
            seen.add((role, text))
        roles, texts = [x[2] for x in own], [x[3] for x in own]
        cost, audit, end = c.cheapest([x[:1] for x in roles], faults) if own else (0, "", 0)
        audit += c.ENDS[end]
        said = "\n".join(f"{a}:{b}" for a, b in c.edited(roles, texts, audit, c.START))
        turns = [x[1] for x in own if x[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in c.LEGAL for a, b in zip(roles, roles[1:]))
        out[i] = (gaps, faults.count(c.BLANK), faults.count(c.AGAIN), faults.count(c.CUT), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def odd():
    r = random.Random(11)
    text = lambda: r.choice(["", " \n", "Yes.", "No", "Why? ", "ü" * 50 + "!", "same.", "word " * 2000, None])
    rows = [(i, t, r.choice(["user", "assistant", "system", "tool", "", None]), text()) for i in (1, 2, 3, None) for t in r.sample([*range(40), None, None], 20)]
    rows += [(7, r.randrange(90), r.choice(["user", "assistant"]), r.choice(["a.", "b.", "c", "d!", ""])) for _ in range(300)]  # ties, copies, one long conversation
    return rows + [(9, 4, "user", "Once.")] * 40 + [(1000 + k, k, "user", "x.") for k in range(40)]


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_every_conversation(spark, odd, block_rows):
    df = spark.createDataFrame([(*x, "z") for x in odd], SCHEMA).repartition(4)
    out = c.repair_damaged(df, block_rows).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == plainly(odd) and len(out) == len(plainly(odd))
    assert any(r.audit == "" for r in out if r.conv_id and r.conv_id >= 1000)  # dropped


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_repaired_rows_give_the_hash(spark, odd, block_rows):
    told, turns = c.repair(spark.createDataFrame([(*x, "z") for x in odd], SCHEMA), block_rows)
    said = {}
    for t in sorted(turns.collect(), key=lambda t: (t.part, t.block, t.at)):
        said.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    assert {r.conv_id: r.repaired_sha256 for r in told.collect()} == {r.conv_id: hashlib.sha256("\n".join(said.get(r.conv_id, [])).encode()).hexdigest() for r in told.collect()}


def test_empty_table(spark):
    told, turns = c.repair(spark.createDataFrame([], SCHEMA))
    assert told.collect() == [] and turns.collect() == [] and c.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage_is_seeded(spark):
    rows = spark.createDataFrame([(1, t, "assistant", "Well. So!", "z") for t in range(60)], SCHEMA)
    seen = Counter((r.turn, r.role, r.text) for r in c.damage(rows).collect())
    for t in range(60):
        slot = zlib.crc32(f"1:{t}".encode()) % 20
        assert seen.get((t, "user" if slot == 4 else "assistant", {1: "", 2: "Well So"}.get(slot, "Well. So!")), 0) == {0: 0, 3: 2}.get(slot, 1)
