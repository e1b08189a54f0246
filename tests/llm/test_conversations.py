"""Conversation repair against a search over all edit scripts, and damage row by row."""

import hashlib
import itertools
import random
import zlib

from tallyspark.llm import conversation_repair as cr
from tallyspark.llm.common import table


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def brute(rows):
    """(cost, audit, repaired) of [(role, text, banned, stub)]: every script of at most two inserts before each turn and at the end, tried out."""
    found = []

    def go(k, cost, audit, out):
        if cost > 3 * len(rows):  # to delete every turn is always right
            return
        for n in range(3):
            for names in itertools.product(("user", "assistant"), repeat=n):
                c, a, o = cost + 2 * n, audit + "I" * n, out + [(x, "") for x in names]
                if k == len(rows):
                    if fits("".join(r[:1] for r, _ in o)):
                        found.append((c, a, "\n".join(f"{r}:{t}" for r, t in o)))
                    continue
                role, text, banned, stub = rows[k]
                go(k + 1, c + 3, a + "D", o)
                if not banned:
                    if role[:1] in ("s", "u", "a"):
                        go(k + 1, c + stub, a + "K", o + [(role, text)])
                    for to in ("user", "assistant"):
                        go(k + 1, c + 2 + stub, a + "R", o + [(to, text)])

    go(0, 0, "", [])
    return min(found)


def by_hand(rows):
    """The columns of repair() for damaged rows (turn, role, text, copies) of one conversation, up to the brute-force search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    rows = [(t, r, x) for t, r, x, n in rows for _ in range(n)]
    seen, judged, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\v\f\r"]
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        judged.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return gaps, faults, sum(p not in ("su", "ua", "au") for p in pairs), judged


def test_like_all_scripts(spark):
    rng, data, want = random.Random(3), [], {}
    for conv in range(150):
        rows = [(rng.choice([None, 1, 2, 3, 4, 7]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]), rng.choice(["Hi.", "Why?", "So", "", " ", "Yes!", "No"]), rng.choice([1, 1, 1, 2, 0])) for _ in range(rng.randint(0, 4))]
        # one fault for each conversation and turn, as damaged() deals them
        rows = [(t, r, x, {y: n for y, _, _, n in rows}[t]) for t, r, x, _ in rows]
        while sum(r[3] for r in rows) > 5:
            rows.pop()
        data += [(conv, *r) for r in rows]
        if rows:
            want[conv] = rows
    got = {r.conv_id: r for r in cr.repair(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, copies int")).collect()}
    assert set(got) == set(want)
    for conv, rows in want.items():
        gaps, faults, illegal, judged = by_hand(rows)
        cost, audit, text = brute(judged)
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, *faults, illegal, cost, audit), rows
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_damage(spark, sf):
    rows = table(spark, sf, "conversations")
    got = {(r.conv_id, r.turn): r for r in cr.damaged(rows).collect()}
    for r in rows.collect():
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fault == 1 else r.text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else r.text
        d = got[r.conv_id, r.turn]
        assert (d.role, d.text, d.copies) == ("user" if fault == 4 else r.role, text, {0: 0, 3: 2}.get(fault, 1))


def test_edges(spark):
    extra = "way string, first string, copies string, text_key string"
    rows = [(None, None, None, None), (None, 1, "user", "Is it?"), (None, 1, "user", "Is it?"), (1, None, None, None), (2, 5, "user", "word " * 200_000 + "."), (2, 6, "assistant", "Yes."), (3, 1, "u", "\t\n"), (4, 3, "user", "Nul \0 and ퟿ 😀.")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], f"conv_id bigint, turn bigint, role string, text string, {extra}")
    got = {r.conv_id: r for r in cr.repair(cr.damaged(df)).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    assert got[3].audit == "D" and got[3].blank == 1
    rows = [(1, None, " ", " ", 1), (None, None, "user", "Is it?", 2), (2, 5, "user", "word " * 200_000 + ".", 1), (2, 6, "assistant", "Yes.", 1), (3, 2, "user", "Gone.", 0)]
    got = {r.conv_id: r for r in cr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies int")).collect()}
    assert (got[1].audit, got[1].blank, got[1].gaps) == ("D", 1, 0)
    assert (got[None].duplicate, got[None].audit, got[None].cost) == (1, "KDI", 5)
    assert (got[2].cost, got[2].audit) == (0, "KK")
    assert (got[3].cost, got[3].audit, got[3].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair(cr.damaged(df.limit(0))).count() == 0


def test_a_long_conversation_keeps_its_order(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('line ', id, '.') as text", "1 as copies")
    (r,) = cr.repair(rows).collect()
    assert (r.cost, r.audit) == (0, "K" * n)
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{('user', 'assistant')[k % 2]}:line {k}." for k in range(n)).encode()).hexdigest()
