"""Conversation repair against an exhaustive search and against plain Python on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ferret.llm import conversation_repair as C

SF = "/root/testdata/sf0.001"
PATTERN = re.compile("(s?(ua)+)?")
FIELDS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def apply(rows, audit):
    """Cost and lines of an audit over (role, text, must go, truncated), or None where it does not fit."""
    out, cost, at, state = [], 0, 0, ""
    for edit in audit:
        wanted = "a" if state == "u" else "u"
        if edit == "I":
            out.append((C.ROLE[wanted], ""))
            cost, state = cost + 2, wanted
            continue
        if at == len(rows):
            return None
        role, text, gone, cut = rows[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        if gone:
            return None
        cost += cut
        if edit == "K":
            if role[:1] != wanted and not (state == "" and role[:1] == "s"):
                return None
            out.append((role, text))
            state = role[:1]
        else:
            out.append((C.ROLE[wanted], text))
            cost, state = cost + 2, wanted
    ok = at == len(rows) and PATTERN.fullmatch("".join(r[:1] for r, _ in out))
    return (cost, out) if ok else None


def exhaustive(rows):
    found = []
    for inserts in range(4):
        for audit in set(itertools.product("DIKR", repeat=len(rows) + inserts)):
            if audit.count("I") == inserts and (got := apply(rows, audit)) is not None:
                found.append((got[0], "".join(audit)))
    return min(found)


def plain(rows):
    """Faults of ordered (turn, role, text), and the rows as the search takes them."""
    n, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in {"su", "ua", "au"} for a, b in zip(rows, rows[1:]))
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, marked


def cheapest(marked):
    """Least (cost, audit) by relaxing suffixes from the end, over plain dictionaries of states."""
    after = {"": (0, ""), "a": (0, "")}

    def inserted(d):
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                t = "a" if s == "u" else "u"
                if t in d:
                    d[s] = min(d.get(s, (1 << 60, "")), (d[t][0] + 2, "I" + d[t][1]))
        return d

    after = inserted(after)
    for role, _, gone, cut in reversed(marked):
        now = {}
        for s in ("", "s", "u", "a"):
            want, found = "a" if s == "u" else "u", []
            if s in after:
                found.append((after[s][0] + 3, "D" + after[s][1]))
            if not gone and want in after:
                found.append((after[want][0] + cut + (0 if role[:1] == want else 2), ("K" if role[:1] == want else "R") + after[want][1]))
            if not gone and s == "" and role[:1] == "s" and "s" in after:
                found.append((after["s"][0] + cut, "K" + after["s"][1]))
            if found:
                now[s] = min(found)
        after = inserted(now)
    return after[""]


def expected(rows):
    """The whole contract for conversations given as (conv_id, turn, role, text)."""
    convs, by = set(), {}
    for conv, turn, role, text in rows:
        convs.add(conv)
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by.setdefault(conv, []).extend([(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    out = {}
    for conv in convs:
        ordered = sorted(by.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        *counts, marked = plain(ordered)
        cost, audit = cheapest(marked)
        lines = apply(marked, audit)[1]
        out[conv] = (*counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def found(df):
    got = [tuple(r[f] for f in FIELDS) for r in df.collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


def test_search_against_all_audits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), "x", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        rows = [(r, t, g, c and not g) for r, t, g, c in rows]
        want = exhaustive(rows)
        codes = [(r[:1], g, c) for r, _, g, c in rows]
        assert C.search(codes, C.START, C.ACCEPT) == want == cheapest(rows)
        for size in (1, 2):  # the same through segments
            parts = [[(a, b, *e) for a in range(4) for b in range(4) if (e := C.search(codes[i:i + size], a, (b,)))] for i in range(0, len(codes), size)]
            assert C.join_segments(parts) == want


def test_long_random_against_suffixes():
    rng = random.Random(5)
    for n in (30, 200, 400):
        rows = [(rng.choice(["user", "assistant", "system"]), "x", rng.random() < 0.1, rng.random() < 0.3) for _ in range(n)]
        rows = [(r, t, g, c and not g) for r, t, g, c in rows]
        assert C.search([(r[:1], g, c) for r, _, g, c in rows], C.START, C.ACCEPT) == cheapest(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.op13_conversation_repair(spark, SF)) == expected(rows)


@pytest.mark.parametrize("segment", [2, 512])
def test_hot_conversation_and_edges(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)  # the driver's value travels with the closure only where it is read there
    rng = random.Random(9)
    hot = [(7, rng.choice([None, *range(300)]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["Hi.", "so", "a b?", "", None, "x" * 3000])) for _ in range(900)]
    rows = hot + [(None, None, None, None), (None, 1, "user", "Yes."), (1, 5, "user", "a."), (1, 5, "user", "a."), (2, 3, "tool", "\x0b "), (3, None, "user", "t."),
                  (3, None, "assistant", "t."), (4, -5, "assistant", "é!\n "), (4, 1 << 60, "user", "z")] + [(c, 0, "user", "q?") for c in range(100, 160)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' seen", "'clash' head", "'clash' h1")
    assert found(C.repair_conversations(C.damage(df))) == expected(rows)


def test_dropped_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 1)], "conv_id long, turn long, role string, text string, copies int")
    got = found(C.repair_conversations(df))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", C.EMPTY_SHA) and got[2][5:7] == (2, "KI")
    assert C.repair_conversations(C.damage(df.where("false"))).collect() == []
    names = df.selectExpr("concat('c', conv_id) conv_id", "turn", "role", "text")
    assert set(found(C.repair_conversations(names))) == {"c1", "c2"}
