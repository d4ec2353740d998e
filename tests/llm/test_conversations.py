"""Conversation repair against brute force, on large conversations and on edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from harvestline.llm import conversation_repair as repair
from harvestline.llm.support import Scratch

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def slow_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}  # state -> cheapest (cost, edits, repaired lines) so far from the end
    for k in range(len(rows), -1, -1):
        now = {q: (0, "", ()) for q in ("", "a")} if k == len(rows) else {}
        if k < len(rows):
            role, text, extra = rows[k][2], rows[k][3], faults[k] == "truncated"
            for q in ("", "s", "u", "a"):
                options = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
                if faults[k] not in ("blank", "duplicate"):
                    for edit, name, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                        c, e, lines = best.get(step.get((q, name[:1])), (None,) * 3)
                        if c is not None:
                            options.append((c + cost + extra, edit + e, (f"{name}:{text}", *lines)))
                now[q] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for q, name in (("", "user"), ("s", "user"), ("u", "assistant"), ("a", "user")):
                if name[0] in now:
                    c, e, lines = now[name[0]]
                    now[q] = min((o for o in (now.get(q), (c + 2, "I" + e, (name + ":", *lines))) if o), key=lambda o: o[:2])
        best = now
    cost, audit, lines = best[""]
    count = faults.count
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow(rows):
    groups = {r[0]: [] for r in rows}
    for row in slow_damage(rows):
        groups[row[0]].append(row)
    return {conv: slow_repair(group) for conv, group in groups.items()}


def run(spark, rows, parts=3, names=ROWS):
    frame = spark.createDataFrame(rows, names).repartition(parts)
    found = repair.repaired_damage(frame, Scratch(spark, "conversations")).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


def test_slow_repair_is_the_cheapest_of_all_edits():
    """The brute force itself, against every sequence of edits on tiny conversations."""
    for roles in itertools.product("suax", repeat=3):
        rows = [(0, k, r, f"{k}." if k != 1 else "1") for k, r in enumerate(roles)]
        best = None
        for length in range(3, 8):
            for edits in itertools.product("DIKR", repeat=length):
                if sum(e != "I" for e in edits) != 3:
                    continue
                left, initials, cost = list(rows), "", 0
                for e in edits:
                    row = left.pop(0) if e != "I" else None
                    initials += {"D": "", "I": "*", "R": "*"}.get(e) if e != "K" else row[2]
                    cost += {"D": 3, "I": 2, "R": 2, "K": 0}[e] + (e in "KR" and not row[3].endswith("."))
                want = "ua" * (len(initials) // 2)
                shapes = [want] if len(initials) % 2 == 0 else ["s" + want] if initials else []
                if any(all(i in ("*", w) and not (i == "*" and w == "s") for i, w in zip(initials, shape))
                       for shape in shapes if len(shape) != 1):
                    best = min(best or (99,), (cost, "".join(edits)))
        assert slow_repair(rows)[5:7] == best


def test_given_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert run(spark, rows) == slow(rows)


def random_rows(seed, convs, longest, nulls=True):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "u"])
            text = rng.choice(["Yes.", "No", "", " \n", "a b!", f"{rng.random()}.", f"{rng.random()}", "x? \t"])
            rows.append((conv, turn + rng.choice([0, 0, 0, 1, 5]), role, text))
            if nulls and rng.random() < 0.1:
                rows.append((rng.choice([conv, None]), rng.choice([turn, None]), rng.choice([role, None]), rng.choice([text, None])))
            if rng.random() < 0.1:
                rows.append(rng.choice(rows))
    return rows


def drop_empty_roles(rows):
    return [(c, t, r or "x", x) if r is not None else (c, t, r, x) for c, t, r, x in rows]


def test_random_conversations_equal_brute_force(spark):
    rows = drop_empty_roles(random_rows(3, 150, 12))
    assert run(spark, rows) == slow(rows)


def test_long_conversations_are_cut_and_joined(spark):
    """One conversation with most of the rows, over many segments and partitions."""
    rows = drop_empty_roles(random_rows(5, 6, 400)) + [(2, 3, "user", "Yes.")] * 3000
    want = slow(rows)
    assert run(spark, rows) == want
    frame = spark.createDataFrame(rows, ROWS)
    cut = repair.repair(repair.damaged(frame), Scratch(spark, "conversations"), most_rows=37, most_chars=200)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in repair.digest(cut).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and len(want) - len(got) <= 1
    assert cut.count() > 100 and max(len(r.audit) for r in cut.select("audit").collect()) < 100


@pytest.mark.parametrize("chunk", [1, 3, 48, 1000])
def test_chunks_give_the_cheapest_least_edits(chunk, monkeypatch):
    """Auctions over chunks of any length equal the brute force over the whole."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    letters = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(60):
        codes = [rng.choice("suaxSUAXDuaua") for _ in range(rng.randrange(1, 40))]
        rows = [(0, k, letters.get(c.lower(), "user"), "" if c == "D" else f"{k}" if c.isupper() else f"{k}.") for k, c in enumerate(codes)]
        want = slow_repair(rows)
        audit, leave = repair.trace("".join(codes), 0, repair.AT_END)
        audit += "I" * (repair.AT_END[leave] // 2)
        assert audit == want[6]


def test_edge_cases(spark):
    assert run(spark, []) == {}
    rows = [(1, 0, None, None), (None, None, None, None), (None, 1, "user", "Hi."), (2, None, "user", "x" * 300_000 + "."),
            (2, None, "assistant", "ok."), (3, 9, "", "no role."), (4, 1, "unknown", "u too.")]
    got, want = run(spark, rows), slow([r for r in rows if r[0] != 3])
    assert {k: v for k, v in got.items() if k != 3} == want
    assert 3 in got
    # every row dropped: zeros, no edits, the hash of nothing
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "x.")])[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_clashing_names(spark):
    rows = random_rows(9, 20, 8)
    rows = drop_empty_roles(rows)
    frame = spark.createDataFrame(rows, ROWS)
    wide = frame.selectExpr("*", *[f"1 AS {c}" for c in (
        "copies", "fault", "rest", "initial", "part", "seg", "whole", "last", "ends", "costs", "codes", "_hit", "_conv",
        "_said", "_at", "_first", "_words", "_copy", "audit", "gaps", "rows")])
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[n] for n in names) for r in repair.repaired_damage(wide, Scratch(spark, "conversations")).collect()}
    assert got == slow(rows)


def test_real_rows_come_back(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes.")]
    segments = repair.repair(spark.createDataFrame(rows, ROWS), Scratch(spark, "conversations"))
    kept = [(r.role, r.text) for r in repair.repaired_rows(segments).collect()]
    row = segments.first()
    assert (row.audit, row.cost) == ("KIKK", 2)
    assert kept == [("user", "Hi."), ("assistant", ""), ("user", "Again."), ("assistant", "Yes.")]
