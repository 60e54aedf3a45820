from __future__ import annotations

import math
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.llm import decontam, langid, packing, quality, simhash, tokencount, toxicity
from marquee.llm.common import Marks, connected_components, fold
from marquee.llm.queries import tokenizer_path
from tests.llm.conftest import ODD


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# SimHash

def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_dedup_equals_brute_force(make):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [r for r in ODD if r[0] not in (7, 8)]
    for i in range(120):
        w = list(base if i % 3 else rng.choices(base, k=50))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "Z" + str(rng.randint(0, 9))
        rows.append((50 + i, " ".join(w), "en"))
    prints = [plain_print(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    want = sorted(((r[0], f"{prints[i]:016x}", min(ids[find(i)])) for i, r in enumerate(rows)), key=str)
    assert by_id(simhash.near_dedup(make(rows))) == want
    assert simhash.near_dedup(make([])).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (12, 2))} | set(map(int, seeds))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    for tile in (4, 4096):
        got = {(min(a, b), max(a, b)) for a, b in simhash.near_links(points, 4, tile).collect()}
        comp = {x: x for x in signed}

        def find(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for a, b in got:
            comp[find(a)] = find(b)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                near = ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
                assert not near or find(a) == find(b)


# Language ID

def test_language_id(make):
    rows = ODD + [(20 + i, s, lang) for i in range(20) for s, lang in [("the dog and the cat are here with that", "en"), ("der hund und die katze sind nicht hier", "de")][i % 2:i % 2 + 1]]
    docs = make(rows)
    model = langid.learn(docs, F.col("doc_id") >= 20)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[1, None] == ("und", 0.0) and got[2, ""][0] == got[4, "12 $$ !!"][0] == "und"
    assert got[9, "der hund liegt auf der matte"][0] == "de"
    assert got[5, "the cat sat on the mat"][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert got[8, "x" * 100_000] == ("de" if model.langs[0] == "de" else "en", 0.0)
    none = langid.learn(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(make([]), model).count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, fold("doc_id", 3) != 1)
    held = langid.identify(docs.where(fold("doc_id", 3) == 1), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# Toxicity and quality

def test_restores_hidden_words(spark):
    words = "idiot loser trash worthless moron stupid the and with house".split()
    docs = spark.createDataFrame([(" ".join(words),)] * 20, "text string")
    r = toxicity.Restorer(toxicity.char_model(toxicity.char_counts(docs)))
    for hidden, word in [("1d10t", "idiot"), ("l-o-s-e-r", "loser"), ("tr@sh", "trash"), ("mooooron", "moron"), ("$tup1d", "stupid"), ("w0rthl3ss", "worthless")]:
        assert word in r.words(f"with {hidden} and"), hidden
    assert "idiot" in r.words("the i d i o t house")
    assert r.words("the house") >= {"the", "house"} and r.words(None) == r.words("") == set()


def test_restores_phrases(spark):
    words = "you idiot loser trash worthless moron stupid the and with house".split()
    docs = spark.createDataFrame([(" ".join(words),)] * 20, "text string")
    r = toxicity.Restorer(toxicity.char_model(toxicity.char_counts(docs)))
    for hidden, found in [("y o u i d i o t", {"you", "idiot"}), ("m0r0n-1d10t", {"moron", "idiot"}), ("y.o.u.l-o-s-e-r", {"you", "loser"}),
                          ("the s t u p 1 d m o r o n house", {"stupid", "moron"}), (" ".join("youidiot" * 9), {"you", "idiot"})]:
        assert found <= r.words(hidden), hidden
    # No word is cut at any length of run.
    for n in range(55, 68):
        assert "moron" in toxicity.restore("-".join("worthless" * 9)[:n].rstrip("-") + "-m-o-r-o-n", r.model, breaks=True).split(), n
    assert "worthless" * 9 == toxicity.restore("-".join("worthless" * 9), r.model)


def test_toxicity_learns_and_scores(spark, make):
    rng = random.Random(6)
    clean = "the and house with tree river stone bread water light".split()
    rows = [(i, " ".join(rng.choices(clean, k=12) + (["scumbag"] if i % 4 == 0 else [])), "en") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(400)] + [(0, 1, 0), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, extra long")
    docs = make(rows + [(1000, "you scumb4g there", "en"), (1001, None, "en"), (1002, "", "en"), (1003, "s c u m b a g", "en")])
    model = toxicity.learn(docs, labels, F.col("doc_id") < 300)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300, 400))
    assert got[1000]["predicted"] == got[1003]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    bare = toxicity.learn(docs, labels, F.lit(False))
    assert {r["score"] for r in toxicity.score(docs, bare).collect()} == {0.0}
    assert toxicity.score(make([]), model).count() == 0


def test_no_count_is_left_out(spark, make):
    docs = spark.createDataFrame([("idiot loser the house",)] * 20 + [("漢字 한글",)], "text string")
    counts = toxicity.char_counts(docs)
    whole, hashed = toxicity.char_model(counts), toxicity.char_model(counts, exact=3)
    assert isinstance(hashed.tri, toxicity.Cells) and isinstance(hashed.bi, toxicity.Cells)
    grams = ["   ", "  i", "idi", "ot ", "  漢", " 漢字", "漢字 ", "한글 ", "zzz"]
    assert all(whole.cost(*g) == hashed.cost(*g) for g in grams) and hashed.tri.get("漢字 ") == 1
    assert whole.total == hashed.total
    rng = random.Random(6)
    clean = "the and house with tree river stone bread water light".split()
    rows = [(i, " ".join(rng.choices(clean, k=12) + (["scumbag", "wretch"] if i % 4 == 0 else [])), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    scores = []
    for block in (2_000_000, 2):
        model = toxicity.learn(make(rows), labels, F.col("doc_id") < 250, block_words=block)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(make(rows), model).collect()})
    assert model.blocks > 1 and scores[0] == scores[1] and len(set(scores[0].values())) > 1


def test_counts_do_not_depend_on_how_many_there_are(spark, monkeypatch):
    """Each n-gram has its own count, however many are held (none shares another's)."""
    rng = random.Random(11)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3)) for _ in range(6000)]
    docs = spark.createDataFrame([(" ".join(words[i::20]),) for i in range(20)] * 2, "text string")
    counts = toxicity.char_counts(docs)
    monkeypatch.setattr(toxicity.Cells, "SLICE", 5000, raising=False)
    few, many = toxicity.char_model(counts), toxicity.char_model(counts, exact=3)
    assert isinstance(few.tri, dict) and not isinstance(many.tri, dict) and not isinstance(many.bi, dict)
    assert len(few.tri) > 20_000
    for a, b in ((few.tri, many.tri), (few.bi, many.bi)):
        assert [g for g, n in a.items() if b.get(g) != n] == []
    unseen = {"".join(rng.choices("abcdefgh", k=3)) for _ in range(200)}
    assert all(many.tri.get(g) == 0 for g in unseen) and (few.uni, few.total) == (many.uni, many.total)


TOKENS = ["the house", "House, (tree) tree. trees treetops", "1d10t l-o-s-e-r mooooron moooon-", "s c u m b a g and a b", "", " \n", "\u00c9t\u00e9 stra\u00dfe \u0130stanbul \u6f22\u5b57\u6f22\u5b57\u6f22 \u00bd \u216b",
          "aaa (bbb) cc c dd! e\u0301t\u00e9 \U00010400\U00010400\U00010400", "|| $$ 12 ... a$ b@ idiot idiots id1ots", "treetop " * 50 + "loser"]


def test_tokens_taken_together_give_the_words_of_each_text(spark, monkeypatch):
    """Counts and evidence of many texts at once against ``Restorer.words``, text by text."""
    docs = spark.createDataFrame([("idiot loser scumbag moron moon house tree trees treetop",)] * 9, "text string")
    restorer = toxicity.Restorer(toxicity.char_model(toxicity.char_counts(docs)))
    texts = TOKENS * 3
    words = [restorer.words(t) for t in texts]
    told = {t for text in texts for t in text.lower().split()}
    own, cores, others = toxicity.told_apart(sorted(told))
    assert dict(zip(own, cores, strict=True)) == {t: toxicity.plain(t) for t in told if toxicity.plain(t)}
    assert sorted(own + others) == sorted(told) and toxicity.told_apart([]) == ([], [], [])
    want = {"": [sum(i % 4 == g for i in range(len(texts))) for g in range(4)]}
    for i, found in enumerate(words):
        for w in found:
            want.setdefault(w, [0] * 4)[i % 4] += 1
    every = sorted(want)[1::2]  # every second word is evidence
    h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in every], np.uint64)
    order = np.argsort(h)
    weights = {w: 1 + i / 7 for i, w in enumerate(every)}
    views = bytes(1 + i % 7 for i in order)
    weight = array("d", [weights[every[i]] for i in order])
    best = [sorted(weights[w] for w in found if w in weights and (1 + every.index(w) % 7) >> (i % 3) & 1)[-3:] for i, found in enumerate(words)]
    assert len({tuple(b) for b in best}) > 5
    for run, most in ((1 << 21, 1 << 20), (1, 1 << 20), (40, 1)):  # all at once; text by text; every token forgotten
        monkeypatch.setattr(toxicity, "_RUN", run)
        counts = toxicity.WordCounts(restorer)
        for k in range(0, len(texts), 7):
            counts.add(texts[k:k + 7], [i % 4 for i in range(k, min(k + 7, len(texts)))])
        assert {r[0]: list(r[1:]) for r in counts.frame()[["word", "neg0", "pos0", "neg1", "pos1"]].itertuples(index=False)} == want
        find = toxicity.Finder(restorer, h[order], weight, views)
        find.without = toxicity.Without(most)
        for _ in range(2):
            assert find.strongest(texts, [i % 3 for i in range(len(texts))]) == best
    assert toxicity.Finder(restorer, h[:0], array("d"), b"").strongest(["a", ""], [0, 2]) == [[], []]


def test_every_learning_row_counts(spark, make):
    passage = "a passage that very many pages share word by word and that goes on for a while "
    texts = [passage + f"then page {i} goes its own way {i * 7} entirely" for i in range(20)] + ["equal text with two labels"] * 3
    docs = make([(i, t, "en") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(23)], "doc_id long, toxic int")
    train = Marks.by_id(docs, labels.withColumnRenamed("toxic", "y"), "doc_id", F.lit(True))
    rows = [r for runs in train.passes for r in train.read(runs).collect()]
    assert sorted((r["text"], r["y"]) for r in rows) == sorted((t, int(i % 5 == 0)) for i, t in enumerate(texts))
    assert len({toxicity.half_of(r["text"]) for r in rows if r["text"] == texts[-1]}) == 1


def test_marks_meet_rows_where_they_are_read(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, i, i, i % 50]), f"text {i}", i % 9, i) for i in range(1500)]
    path = f"{tmp_path}/docs.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, y int, has long").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    marks = spark.createDataFrame([(i, i % 3 - 1) for i in range(0, 1500, 2)], "doc_id long, y int")
    want = sorted((t, int(i % 3 - 1 > 0)) for i, t, _, _ in rows if i is not None and i % 2 == 0 and i < 1400)
    for entries in (1_000_000, 9, 1):
        train = Marks.by_id(docs, marks, "doc_id", F.col("doc_id") < 1400, entries)
        found = [train.read(runs) for runs in train.passes]
        assert all(f.columns == ["doc_id", "text", "has", "_row", "y"] for f in found)
        assert sorted((r["text"], r["y"]) for f in found for r in f.collect()) == want
        assert (len(found) == 1) == (entries > 9)
        assert not any("Exchange hashpartitioning" in f._jdf.queryExecution().executedPlan().toString() for f in found)
    assert Marks.by_id(docs, marks.limit(0), "doc_id", F.lit(True)).passes == []


def test_evidence_counts_equal_a_plain_recount(spark, make):
    rng = random.Random(6)
    clean = "the and house with tree river stone bread water light".split()
    rows = [(i, " ".join(rng.choices(clean, k=12) + (["scumbag", "wretch"] if i % 4 == 0 else ["tr33"])), "en") for i in range(300)]
    docs, labels = make(rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") < 250)
    seen, n = {}, [0] * 4
    for i, text, _ in rows[:250]:
        group = 2 * toxicity.half_of(text) + (i % 4 == 0)
        n[group] += 1
        for w in model.restorer.words(text):
            seen.setdefault(w, [0] * 4)[group] += 1

    def ratio(pos, neg, n_pos, n_neg):
        return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))

    want = {}
    for w, (a, b, c, d) in seen.items():
        holds = [b >= 2 and ratio(b, a, n[1], n[0]) > 1, d >= 2 and ratio(d, c, n[3], n[2]) > 1]
        weight = ratio(b + d, a + c, n[1] + n[3], n[0] + n[2])
        if b + d >= 6 and any(holds) and weight > 1:
            want[xxhash.xxh64_intdigest(w.encode(), 42)] = (round(weight, 9), holds[1] + 2 * holds[0] + 4 * all(holds))
    got = {r["h"] % (1 << 64): (round(r["w"], 9), r["views"]) for r in model.evidence.collect()}
    assert got == want and len(got) > 2


def test_restored_word_is_the_cheapest_of_all_readings(spark):
    """The Viterbi path against every reading of short runs."""
    words = "idiot loser trash moron stupid the and house".split()
    docs = spark.createDataFrame([(" ".join(words),)] * 20, "text string")
    model = toxicity.char_model(toxicity.char_counts(docs))

    def every(run):
        def go(i, a, b, raw, cost, out):
            if i == len(run):
                yield cost + model.cost(a, b, " "), out
                return
            ch = run[i]
            options = [(c, toxicity.SUBSTITUTE) for c in toxicity.LEET.get(ch, "")] + [(ch, 0.0)] * ch.isalpha()
            tripled = i + 1 < len(run) and run[i + 1] == ch or i > 1 and run[i - 2] == ch
            for c, price in options:
                yield from go(i + 1, b, c, ch, cost + price + model.cost(a, b, c), out + c)
            if ch in toxicity.SEPARATORS:
                yield from go(i + 1, a, b, raw, cost + toxicity.DROP, out)
            elif not options:
                yield from go(i + 1, a, b, raw, cost, out)
            if ch == raw and options:
                yield from go(i + 1, a, b, raw, cost + (toxicity.REPEAT if tripled else toxicity.PAIR), out)
        found = list(go(0, " ", " ", "", 0.0, ""))
        best = min(c for c, _ in found)
        return {o for c, o in found if c < best + 1e-9}

    for run in ["1d10t", "l-os*r", "mooor0n", "$tup1d", "7r@$h", "a++", "i|i", "66g", "-", "5s5s", "t.h.3"]:
        assert toxicity.restore(run, model) in every(run), run


def test_quality_held_out(spark, make):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    machine = quality.learn(docs, labels, fold("doc_id", 3) != 1, metadata=("n_chars",))
    held = quality.score(docs.where(fold("doc_id", 3) == 1), machine, metadata=("n_chars",)).join(labels, "doc_id")
    assert held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    odd = quality.score(make(ODD), machine, metadata=("n_chars",)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.learn(docs, labels, F.lit(False))
    assert {r["score"] for r in quality.score(make(ODD[:3]), none).collect()} == {0.5}


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    p, x = np.arange(9), rng.normal(size=9)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert m.logit(p, x) == pytest.approx(0.3 + m.weights[:9] @ x + pairs)


# Packing and token counts

PATH = tokenizer_path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abEÉéßÀ'’.!$19 \n\t\x1c\x85\xa0漢Σςİí<|>endoftxsl") , max_size=40))
def test_word_cache_equals_the_tokenizer(text):
    ids = packing._ids(PATH)
    assert np.frombuffer(ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(make):
    rows = ODD + [(100 + i, "word " * (37 * i % 900), "en") for i in range(200)]
    parts = packing.pack_documents(make(rows), PATH, seq_len=256, grain=16, with_ids=True).collect()
    tokenizer = packing._ids(PATH).tokenizer
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in parts:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] not in (5, None):
            docs[r["doc_id"]].append((r["start"], r["ids"]))
    for d in docs.values():
        whole = [x for _, ids in sorted(d, key=lambda v: v[0]) for x in ids]
        assert whole in want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in parts) == sum(map(len, want))
    assert sum(r["length"] for r in parts) > 0.9 * 256 * len(sequences)
    assert packing.pack_documents(make([]), PATH).count() == 0


def test_cutting_plan_covers_demand_near_the_bound():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 400, 64)
    plan = packing.cutting_plan(demand)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all(p @ np.arange(1, 65) <= 64 for p, _ in plan)
    # What the program's own duals bound from below, by linear programming
    # duality: no pattern is worth more than 1 under them.
    duals = packing.pattern_duals(demand)
    worth, _ = packing._knapsack(duals, 64)
    assert worth <= 1 + 1e-6 and (duals >= 0).all()
    bound = float(demand @ duals) / max(1.0, worth)
    rounded = len(np.flatnonzero(demand))  # a pattern in the basis for each size
    assert bound - 1e-6 <= sum(n for _, n in plan) <= bound + rounded


def test_trie_counts_equal_plain_dynamic_programming(make):
    costs = {"a": 1.0, "b": 1.1, "ab": 1.5, "abc": 2.0, "c": 3.0, "▁": 0.5, "▁a": 1.2}
    scorer = tokencount.TrieScorer(costs)

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            options = [(best[e - 1][0] + scorer.fallback * n, best[e - 1][1] + n)]
            options += [(best[s][0] + costs[word[s:e]], best[s][1] + 1) for s in range(e) if word[s:e] in costs]
            best.append(min(options))
        return best[-1][1]

    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("abcé", k=rng.randint(1, 8))) for _ in range(300)]
    assert scorer.counts(words) == {w: plain(w) for w in words}
    rows = tokencount.token_counts(make(ODD), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ODD)
    assert all((r["n_tokens"] == 0) == (r["n_pretokens"] == 0) for r in rows)
    assert {r["n_pretokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}


# Decontamination

def brute_leaks(rows, items, window):
    pats = [(i, w) for i, t in items for w in set(decontam.windows_of(decontam.words_of(t), window))]
    out = []
    for i, t, _ in rows:
        words, hit, ids = decontam.words_of(t), set(), set()
        for item, p in pats:
            for s in range(len(words) - len(p) + 1):
                if tuple(words[s:s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    ids.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(ids), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_leaks_equal_brute_force(spark, make, block_bytes):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(["a", "B", "c", "é"], k=n))
    items = [(i, say(rng.randint(0, 9))) for i in range(12)] + [(3, "a b c a b"), (None, "the cat sat"), (50, None), (51, "?!")]
    rows = ODD + [(100 + i, say(rng.randint(0, 60)), "en") for i in range(60)]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    found = decontam.find_leaks(make(rows), bench, window=4, block_bytes=block_bytes)
    got = decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert by_id(got) == brute_leaks(rows, items, 4)
    assert decontam.find_leaks(make(rows), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontam.find_leaks(make([]), bench).count() == 0
    # Whatever the benchmark's size, no stage runs the search more than once.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == (block_bytes > 1000)
