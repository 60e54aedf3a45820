from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from marquee.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, fault string, code string, rows string"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y", "z") for r in rows], SCHEMA)


def damaged(rows):
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = zlib.crc32(f"{c if c is not None else ' '}:{t if t is not None else ' '}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        yield from [(c, t, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)


def faults(rows):
    """Rows of one conversation, in order, with their first fault."""
    seen = set()
    for _, _, role, text in rows:
        solid = text.strip(SPACE)
        yield (role, text), "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))


def every_way(marked):
    """All edits of a conversation with up to two inserts in a row: (cost, audit, rows)."""
    def edits(row, fault):
        role, text = row
        yield 2, "D", []
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            yield more, "K", [(role, text)]
            yield from ((1 + more, "R", [(r, text)]) for r in ("user", "assistant"))

    empty = [(0, "", [])] + [(5 * n, "I" * n, [(r, "") for r in rs]) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    slots = [empty]
    for row, fault in marked:
        slots += [list(edits(row, fault)), empty]
    for way in itertools.product(*slots):
        out = [r for _, _, rows in way for r in rows]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            yield sum(c for c, _, _ in way), "".join(a for _, a, _ in way), out


def test_against_every_way():
    rng = random.Random(5)
    kinds = [(r, t) for r in ("system", "user", "assistant", "tool", "") for t in ("a.", "b", "", "c!")]
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3):
        marked = list(faults([(0, 0, *rng.choice(kinds)) for _ in range(n)]))
        cost, audit, rows = min(every_way(marked), key=lambda w: w[:2])
        codes = "".join(chr(97 + 3 * (r[:1] in ("s", "u", "a") and "sua".index(r[:1]) if r[:1] in ("s", "u", "a") else 3)
                            + {"": 0, "truncated": 1}.get(f, 2)) for (r, _), f in marked)
        got = repair.repair_codes(codes)
        assert got[:2] == (cost, audit)
        rebuilt = [(("user", "assistant")[-p - 1], "") if p < 0 else (("user", "assistant")[p % 3 - 1] if p % 3 else marked[p // 3][0][0], marked[p // 3][0][1]) for p in got[2]]
        assert rebuilt == rows


def by_strings(codes):
    """The same minimum over (cost, audit) pairs, at any length."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    def insert(layer):
        for _ in range(2):
            for s, (c, a) in list(layer.items()):
                layer[nxt[s]] = min(layer.get(nxt[s], (1 << 60, "")), (c + 5, a + "I"))
        return layer

    layer = insert({0: (0, "")})
    for code in codes:
        initial, fault = divmod(ord(code) - 97, 3)
        step = []
        for s, (c, a) in layer.items():
            step.append((s, (c + 2, a + "D")))
            if fault < 2:
                step.append((nxt[s], (c + 1 + 5 * fault, a + "R")))
                if initial + 1 == nxt[s] or (initial, s) == (0, 0):
                    step.append((initial + 1, (c + 5 * fault, a + "K")))
        layer = {}
        for s, v in step:
            layer[s] = min(layer.get(s, (1 << 60, "")), v)
        insert(layer)
    return min(layer[s] for s in (0, 3) if s in layer)


def test_long_conversations():
    rng = random.Random(7)
    for n in (5, 20, 60, 400, 3000):
        codes = "".join(chr(97 + rng.choice([0, 3, 3, 4, 5, 6, 6, 6, 7, 9, 11])) for _ in range(n))
        assert repair.repair_codes(codes)[:2] == by_strings(codes)


def test_query_cases(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "user", None, "tool", ""]),
             rng.choice(["Yes.", "No", "What?", "", None, " \t\x0b", "a b!\n", "é…", "ok \x1c"]))
            for c in [*range(40), None] for t in rng.sample([None, 0, 1, 2, 3, 5, 9], rng.randint(1, 4))]
    rows += rows[:5] + [(100, 0, "user", "w" * 100_000 + "."), (100, 1, "assistant", "fine.")]
    got = {r["conv_id"]: r for r in repair.digest(repair.repair(repair.damage(frame(spark, rows))), frame(spark, rows)).collect()}
    assert len(got) == 42
    for c in [*range(40), None, 100]:
        mine = sorted(damaged([r for r in rows if r[0] == c]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marked = list(faults(mine))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        r = got[c]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [sum(f == k for _, f in marked) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        if len(marked) <= 3:
            cost, audit, out = min(every_way(marked), key=lambda w: w[:2])
            assert (r["cost"], r["audit"]) == (cost, audit)
            assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_empty(spark):
    none = frame(spark, [])
    assert repair.digest(repair.repair(repair.damage(none)), none).count() == 0
    # A table whose rows are all dropped: rows of zeros stay.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = frame(spark, [(gone, 0, "user", "a.")])
    r = repair.digest(repair.repair(repair.damage(one)), one).first()
    assert (r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("codes, cost, audit", [("", 0, ""), ("dg", 0, "KK"), ("d", 2, "D"), ("a", 2, "D"), ("adg", 0, "KKK"), ("dd", 1, "KR")])
def test_small(codes, cost, audit):
    assert repair.repair_codes(codes)[:2] == (cost, audit)
