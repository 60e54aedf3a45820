from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import exactdedup, linededup
from marquee.llm.common import Rows
from tests.llm.conftest import ODD

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(BLANK)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t, _ in rows:
        norm = (t or "").translate(BLANK)
        _, null, keep = min(groups[norm])
        keep = None if null else keep
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("key_bits", "bucket_keys"), [(64, 20_000), (64, 2), (3, 2)])
def test_exact_dedup_equals_brute_force(make, key_bits, bucket_keys):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(rng.choices(["a", "b ", "c"], k=rng.randint(1, 3))), "en") for i in range(150)]
    got = exactdedup.exact_dedup(make(rows), bucket_keys=bucket_keys, key_bits=key_bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4096).select(F.xxhash64("id").alias("key"))
    cells, bits = exactdedup.directory(keys, 100, 64)
    held = (keys.withColumn("cell", F.shiftrightunsigned("key", 64 - bits)).join(cells, "cell")
            .groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    assert held[0] <= 100 and held[1] == 4096


def test_lookup_goes_through_directory_and_chain(make):
    """Nothing is found without the directory, and no chain without its texts."""
    rng = random.Random(3)
    data = [(100 + i, " ".join(rng.choices(["a", "b ", "c"], k=rng.randint(1, 3))), "en") for i in range(150)]
    rows = Rows(make(data))
    members = exactdedup._members(rows, "doc_id", "text", 5)
    index = exactdedup.build(rows, members, "doc_id", "text", 2, 5, 1_000_000)
    entries = index.entries.collect()
    by_key = defaultdict(list)
    for e in entries:
        by_key[e["bucket"], e["key"]].append(e)
    assert max(map(len, by_key.values())) > 1 and len({b for b, _ in by_key}) > 1
    for chain in by_key.values():
        assert [e["chain"] for e in sorted(chain, key=lambda e: e["chain"])] == list(range(1, len(chain) + 1))
        assert all(e["length"] == len(chain) and (e["text"] is not None) == (len(chain) > 1) for e in chain)

    def found(i):
        return exactdedup.lookup(i, rows, members, "doc_id", "text", 1_000_000).where("size > 1").count()

    whole = found(index)
    copies = defaultdict(int)
    for _, t, _ in data:
        copies[t.translate(BLANK)] += 1
    assert whole == sum(n for n in copies.values() if n > 1)
    first = min(b for b, _ in by_key)
    moved = F.when(F.col("bucket") == first, -1).otherwise(F.col("bucket")).cast("long")
    lost = found(exactdedup.Index(index.cells.withColumn("bucket", moved), index.bits, index.entries, index.key_bits))
    assert 0 < lost < whole
    assert found(exactdedup.Index(index.cells.withColumn("bucket", F.lit(-1).cast("long")), index.bits, index.entries, index.key_bits)) == 0
    unchained = index.entries.withColumn("text", F.lit("?"))
    assert 0 < found(exactdedup.Index(index.cells, index.bits, unchained, index.key_bits)) < whole


def test_only_texts_with_a_shared_key_move(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    rows = [(i, f"text {i if i % 5 else 0}", "en") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    got = exactdedup.exact_dedup(docs, entries=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)
    assert "text#" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_empty_tables(make):
    assert exactdedup.exact_dedup(make([])).count() == 0
    assert linededup.line_dedup(make([])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, threshold):
    occ = sorted((i is not None, i or 0, at, line) for i, t, _ in rows for at, line in enumerate((t or "").split("\n")) if line.translate(BLANK))
    lines = sorted({o[3] for o in occ})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first, out = {}, defaultdict(lambda: [0, 0, 0, 0, set()])
    for has, i, at, line in occ:
        mine = first.setdefault(find(line), (i if has else None, at, i, has))
        o = out[i if has else None]
        o[0] += 1
        o[1] += links[line] > 0
        o[2] += links[line]
        if mine[:2] != (i if has else None, at):
            o[3] += 1
            if mine[0] is not None:
                o[4].add(mine[0])
    return sorted(((k, *v[:4], sorted(v[4])) for k, v in out.items()), key=str)


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup_equals_brute_force(make, threshold):
    rng = random.Random(threshold)
    rows = [(None, "ab\n\nabc", "en"), (0, None, "en"), (1, "", "en"), (2, " \n \t", "en"), (3, "é\nè\nee", "fr"), (4, "ab\nab", "en")]
    for i in range(40):
        base = rng.choice(["the quick brown fox", "a", "", "license text here", "né à Paris"])
        lines = []
        for _ in range(rng.randint(1, 4)):
            s = list(base)
            for _ in range(rng.randint(0, 2)):
                p = rng.randint(0, len(s))
                s[p:p + rng.randint(0, 1)] = rng.choice(["x", "", "é"])
            lines.append("".join(s))
        rows.append((10 + i, "\n".join(lines), "en"))
    got = [tuple(r) for r in linededup.line_dedup(make(rows), threshold=threshold).collect()]
    assert sorted(got, key=str) == brute_lines(rows, threshold)


def test_verification_is_edit_distance(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abé", k=rng.randint(0, 7))), "".join(rng.choices("abé", k=rng.randint(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = df.select("a", "b", linededup.within(F.col("a"), F.col("b"), t).alias("near")).collect()
        assert all(r["near"] == (edits(r["a"], r["b"]) <= t) for r in got)


def test_blank_lines_are_found_by_their_first_characters(make):
    """No JVM string for every code point of the corpus; a blank is one of the six."""
    blanks, others = "\t\x0b\x0c\r ", "\x00\x08\x0e\x1c\x1f\x85\xa0\u2003\u2028\u3000\ufeff"
    rows = [(i, "\n".join([c, c * 3, f"{blanks}{c}", f"{c}{blanks}", f"{blanks}{c}{blanks}"]), "en") for i, c in enumerate(blanks + others)]
    rows += [(50 + i, t, "en") for i, t in enumerate([blanks, f"\n{blanks}\n\n", f"{blanks}a {blanks}\n b", f"{blanks}{blanks}é", ""])]
    found = linededup.line_dedup(make(rows))
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_lines(rows, 1)
    assert {r.doc_id for r in found.collect()} == {*range(len(blanks), len(blanks + others)), 52, 53}


def test_files_of_picked_lines_follow_their_size(spark, make, monkeypatch):
    """Few lines picked by every task are not a file for each task."""
    parts: dict[str, int] = {}

    def noted(df, name, write=linededup.written):
        out = write(df, name)
        parts[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(linededup, "written", noted)
    # Many lines, in as many files as tasks; a few of them link or repeat.
    rows = [(i, "\n".join([hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(5)]
                          + [f"near {i // 2} copy {'x' * (i % 2)}", f"again {i // 3}"] * (i < 60)), "en") for i in range(600)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.files.openCostInBytes",
                                           "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "16k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
        found = linededup.line_dedup(make(rows)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(r.n_lines for r in found) == 5 * 600 + 2 * 60 and sum(r.n_links for r in found) >= 60
    assert parts["lines"] >= 8
    assert parts["line-texts"] <= parts["lines"] // 2 and parts["line-marks"] <= parts["lines"] // 2


@pytest.mark.parametrize(("crowd", "narrower"), [(1, 2), (3, 16)])
def test_crowded_windows_equal_brute_force(make, monkeypatch, crowd, narrower):
    """Substituted, inserted and struck out code points, runs among them, in groups
    that are split down to one code point."""
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "NARROWER", narrower)
    rng = random.Random(crowd)
    lines = {"".join(rng.choices("aé", k=rng.randint(1, 6))) for _ in range(60)} | {"a" * k for k in range(1, 12)}
    lines |= {f"the same {w} for all of them" for w in ("", "a", "b", "aa", "ab", "ba", "bb", "aab", "baa", "\U0001f600", "\U0001f600a", "a\U0001f600")}
    rows = [(i // 2, f"{line}\n{line if i % 7 == 0 else ''}", "en") for i, line in enumerate(sorted(lines))]
    got = [tuple(r) for r in linededup.line_dedup(make(rows)).collect()]
    assert sorted(got, key=str) == brute_lines(rows, 1)


def test_crowds_make_no_square_of_pairs(make, monkeypatch):
    """Lines that differ in a number, or in one code point at one place."""
    made: dict[str, int] = {}

    def noted(df, name, write=linededup.written):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "written", noted)
    n = 300
    rows = [(i, f"a line of a licence text, number {i:04d} of them, that goes on for a while\none {chr(0x4e00 + i)} of many", "en") for i in range(n)]
    got = {r.doc_id: tuple(r)[1:] for r in linededup.line_dedup(make(rows)).collect()}
    # Numbers of four digits below 300: 9 + 9 others by the last two, 2 by the hundreds.
    assert got == {i: (2, 2, n - 1 + 20, 2 * (i > 0), [0] * (i > 0)) for i in range(n)}
    assert max(made.values()) < 50 * n
    assert made["line-pairs"] <= 16 * n and made["line-links"] <= 10 * n
    assert made["line-crowds"] == n
