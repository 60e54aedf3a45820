from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from marquee.llm import prefixtrie
from marquee.llm.common import fold

SCHEMA = "conv_id long, turn long, role string, text string, node long, parent long, place long, digest string, n long, x long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, "q", 9, 9) for r in rows], SCHEMA)


def report(df):
    convs, rows = prefixtrie.shared_heads(prefixtrie.turn_rows(df), group=5, head=fold("conv", 9), most=8)
    found = prefixtrie.node_report(prefixtrie.build(convs, rows))
    assert found.dtypes == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((t is not None, t or 0, digest, role, text))
    turns = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, ms in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in kids
    return sorted([(ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, ms in members.items()], key=str)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é漢", "", None]))
            for c in [*range(60), 63, 64, 997] for t in rng.choices([None, 0, 1, 2, 5, 2000, -3], k=rng.randint(1, 6))]
    rows += rows[:9] + [(None, 0, "user", "nobody's"), (200, 0, "user", "w" * 100_000), (201, 0, "ab", ""), (202, 0, "a", "b")]
    assert report(frame(spark, rows)) == plain(rows)
    assert report(frame(spark, [])) == []


def test_long_chain_beside_a_wide_parent(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SLICE", 16)
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    rows = [(1000, t, "user", f"t{t}") for t in range(150)]
    rows += [(2000 + k, t, "user", f"t{t}" if t < 130 else f"{k}") for k in (1, 6) for t in range(135)]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(2)]  # one conversation many times
    rows += [(c, 0, "user", f"only {c}") for c in range(300, 340)]
    assert report(frame(spark, rows)) == plain(rows)


def test_totals_of_random_trees(spark):
    rng = random.Random(11)
    nodes, depth = [(0, None, 0, 5)], {0: 0}
    for n in range(1, 160):
        p = n - 1 if rng.random() < 0.6 else rng.randrange(n)
        depth[n] = depth[p] + 1
        nodes.append((n, p, depth[n], rng.randint(0, 9)))
    nodes += [(500, None, 0, 3), (501, 500, 1, 4)]  # a second tree
    total = {n: w for n, _, _, w in nodes}
    for n, p, _, _ in reversed(nodes):
        if p is not None:
            total[p] += total[n]
    df = spark.createDataFrame(nodes, "node long, parent long, depth long, w long")
    assert {r["node"]: r["total_w"] for r in prefixtrie.subtree_totals(df, ("w",)).collect()} == total


def test_digest_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    ends = spark.range(1000).select((F.col("id") % 3 * F.when(F.col("id") < 900, 0).otherwise(1)).alias("node"), (F.col("id") - 40).alias("conv")).repartition(5)
    by = defaultdict(list)
    for r in ends.collect():
        by[r["node"]].append(r["conv"])
    got = {r["node"]: r["sha256"] for r in prefixtrie.id_digests(ends).collect()}
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest() for n, cs in by.items()}
