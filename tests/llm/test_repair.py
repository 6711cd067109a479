"""Conversation repair against plain dynamic programming over whole strings of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plotlink.llm import repair

INITIALS = {"u": (("", "s", "a"), "u"), "a": (("u",), "a"), "s": (("",), "s")}


def cheapest(rows):
    """(cost, edits, repaired turns) of rows (role, text, fault): for each state of the pattern the least cost and string."""
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def insert(states):
        for _ in range(3):
            for g, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if g in INITIALS[role[0]][0]:
                        put(states, role[0], (cost + 5, audit + "I", (*out, f"{role}:")))
        return states

    for role, text, fault in rows:
        after = {}
        for g, (cost, audit, out) in insert(best).items():
            put(after, g, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    before, state = INITIALS.get(new[:1], ((), None))
                    if g in before:
                        put(after, state, (cost + price + more, audit + letter, (*out, f"{new}:{text}")))
        best = after
    ends = insert(best)
    return min(ends[g] for g in ("", "a") if g in ends)


def plain(rows, ids):
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = set()
    for c in set(ids):
        seen, kept, counts, illegal, last = set(), [], defaultdict(int), 0, None
        turns = sorted(groups[c], key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        for _, _, role, text in turns:
            core = re.sub(r"[ \t-\r]+\Z", "", text)
            fault = "blank" if not re.search(r"[^ \t-\r]", text) else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
            last = role[:1]
            kept.append((role, text, fault))
        known = [t for there, t, _, _ in turns if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, repaired = cheapest(kept)
        out.add((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = []
    for c in range(220):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "up"])
            text = rng.choice(["Yes.", "No!", "Why?  \n", "So and", "", " \t", None, f"t{rng.randint(0, 99)}.", "Ende é.\v"])
            rows.append((c, rng.choice([turn] * 6 + [None, turn + 3]), role, text))
    for turn in range(700):  # hot
        rows.append((500, turn, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice([f"text {turn}.", f"text {turn}", "again."])))
    rows += [(501, 0, "user", "long " * 50_000 + "."), (501, 1, "assistant", "x" * 100_000), (None, None, None, None), (None, 1, "user", "a."), (502, 5, "user", "a."), (502, 5, "user", "a."), (-3, 10**12, "user", "a."), (-3, 1, "system", "b.")]
    return rows


def test_report_and_damage(spark, talks):
    df = spark.createDataFrame(talks, repair.TURNS)
    got = [tuple(r) for r in repair.repair_damaged(df).collect()]
    want = plain(damage(talks), [r[0] for r in talks])
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_of_long_conversations(spark, talks, block):
    df = spark.createDataFrame(talks, repair.TURNS).repartition(5)
    got = [tuple(r) for r in repair.report(df, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(talks, [r[0] for r in talks])


def test_ties_take_the_least_letters():
    rng = random.Random(5)
    for _ in range(4000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 9))]
        code = {"s": 0, "u": 1, "a": 2, "t": 3}
        codes = "".join(chr(65 + 4 * code[r[0][0]] + {None: 0, "blank": 1, "truncated": 3}[r[2]]) for r in rows)
        cost, audit, _ = cheapest(rows)
        assert repair.solve(codes) == (audit, cost)


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], repair.TURNS + ", grp string, idx string")
    got = sorted((r.conv_id, r.place, r.edit, r.role, r.text) for r in repair.repaired(df).collect())
    assert got == [(1, 0, "K", "user", "Again."), (1, 1, "K", "assistant", "Yes.")]
    assert repair.repair_damaged(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0
