"""Structure repair against a plain search over all edits."""

import hashlib
import zlib
from collections import defaultdict
from itertools import groupby, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reliq.llm import repair

KINDS = [*range(8), repair.BLANK, repair.DUPLICATE]
SCHEMA = "conv_id long, turn long, role string, text string, conv int, part string, key string, kind string, hash string"
FILLED = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def searched(rows):
    """Least (cost, audit, repaired lines) of rows (role, text, must go, truncated): every edit from every state, row by row."""
    now = {"": (0, "", ())}
    for role, text, goes, cut in rows:
        new = {}

        def put(state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = cost, audit, lines

        spread = list(now.items())
        for state, (cost, audit, lines) in now.items():
            filled, behind = FILLED[state]
            spread.append((behind, (cost + 2, audit + "I", (*lines, f"{filled}:"))))
            second, after = FILLED[behind]
            spread.append((after, (cost + 4, audit + "II", (*lines, f"{filled}:", f"{second}:"))))
        for state, (cost, audit, lines) in spread:
            put(state, cost + 3, audit + "D", lines)
            if not goes:
                if role[:1] and role[:1] in FOLLOWS[state]:
                    put(role[:1], cost + cut, audit + "K", (*lines, f"{role}:{text}"))
                filled, behind = FILLED[state]
                put(behind, cost + 2 + cut, audit + "R", (*lines, f"{filled}:{text}"))
        now = new
    ends = []
    for state, (cost, audit, lines) in now.items():
        while state in ("s", "u"):
            filled, state = FILLED[state]
            cost, audit, lines = cost + 2, audit + "I", (*lines, f"{filled}:")
        ends.append((cost, audit, lines))
    return min(ends)


def of_kinds(kinds):
    return [(repair.INITIALS[k & 3] if k < 8 else "x", "t", k >= 8, bool(k & 4) and k < 8) for k in kinds]


def test_all_short_conversations():
    for n in range(4):
        for kinds in product(KINDS, repeat=n):
            assert repair.least_audit(bytes(kinds)) == searched(of_kinds(kinds))[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(KINDS), min_size=1, max_size=40), st.data())
def test_halves_and_blocks_meet(kinds, data):
    kinds = bytes(kinds)
    cost, want, _ = searched(of_kinds(kinds))
    assert repair.least_audit(kinds) == want
    cuts = sorted({0, len(kinds), *data.draw(st.lists(st.integers(0, len(kinds)), max_size=5))})
    blocks = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
    matrices = [repair.stretch(b) for b in blocks]
    states = repair.crossings(matrices, 0, repair.END, repair.forward, repair.backward)
    made, total = "", 0
    for block, matrix, entry, leave in zip(blocks, matrices, [0, *states], states):
        made += "".join(repair.row_edits(block, entry, tuple(0 if s == leave else repair.NEVER for s in repair.STATES)))
        total += matrix.cost[entry][leave]
    assert made + repair.TAIL[states[-1]] == want and total + repair.END[states[-1]] == cost


def reported(rows):
    """What the operator should say of rows (conv_id, turn, role, text), by conversation."""
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults, made = set(), [], []
        for _, _, role, text in own:
            bare = text.strip(repair.SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            made.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, _, _ in own if known}
        cost, audit, lines = searched(made)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, lines)
    return out


ODD = [
    (1, 1, "system", "Be kind."), (1, 2, "user", "Hi!"), (1, 3, "assistant", "Hello"), (1, 3, "assistant", "Hello"), (1, 7, "user", "Hi!"), (1, 8, "user", " \t"),
    (2, None, "user", "What?"), (2, None, None, "x."), (2, 5, "tool", "y."), (2, 5, "", "z."), (2, 4, "assistant", None), (2, -2, "Assistant", "q."),
    (3, 1, None, None), (3, 2, "user", ""), (None, 1, "user", "lost."), (None, None, "assistant", "lost too?"), (None, 1, "user", "lost."),
    (4, None, "assistant", "first."), (4, None, "assistant", "first."), (5, 1, "assistant", "a." * 20_000), (5, 2, "assistant", "ü" * 9),
    *((6, i, ("user", "assistant", "system")[i * i % 3], f"text {i % 17}" + "." * (i % 4 > 0)) for i in range(60)), *((7, 3, "user", "same.") for _ in range(50)), (7, 3, "user", "then"),
]


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_tables(spark, block):
    rows = spark.createDataFrame([(*r, 1, "p", "k", "x", "h") for r in ODD], SCHEMA).repartition(5)
    reports, repaired = repair.repair(rows, block=block)
    want = reported(ODD)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in reports.collect()}
    assert got == {c: v[:-1] for c, v in want.items()}
    turns = sorted(repaired.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place))
    lines = {c: tuple(f"{r.role}:{r.text}" for r in own) for c, own in groupby(turns, lambda r: r.conv_id)}
    assert lines == {c: v[-1] for c, v in want.items() if v[-1]}
    digests = {r.conv_id: r.repaired_sha256 for r in repair.with_digests(rows.select("conv_id"), reports, repaired).collect()}
    assert digests == {c: hashlib.sha256("\n".join(v[-1]).encode()).hexdigest() for c, v in want.items()}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(12) for t in range(20)] + [(None, None, None, None), (None, 7, None, "x.")]
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    made = spark.createDataFrame([(*r, 1, "p", "k", "x", "h") for r in rows], SCHEMA)
    assert sorted(map(str, repair.damaged(made).collect())) == sorted(str(r) for r in spark.createDataFrame(want, "conv_id long, turn long, role string, text string").collect())
    assert len(want) != len(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    reports, repaired = repair.repair(empty)
    assert reports.collect() == [] and repaired.collect() == []
    gone = repair.with_digests(spark.createDataFrame([(9,)], "conv_id long"), reports, repaired).collect()
    assert [tuple(r) for r in gone] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
