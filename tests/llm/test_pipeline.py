from __future__ import annotations

import gc
import itertools
import weakref
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from marquee.llm import common, decontam, langid, packing, queries, simhash
from marquee.llm.common import fold
from marquee.llm.queries import PACK_TOKENIZER, tokenizer_path
from tests.llm.conftest import ODD


def test_stages_keep_the_columns(spark, make, tmp_path):
    bench = spark.createDataFrame([(1, "der hund liegt auf der matte")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(ODD)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        left[name] = {r["doc_id"] for r in docs.collect()}
    assert not {1, 2, 3, 4} & left["language_id"] and {5, 6, 7, 9} <= left["language_id"]
    assert 6 in left["exact_dedup"] and 5 not in left["exact_dedup"]
    assert 9 in left["simhash_dedup"] and 9 not in left["decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == left["decontamination"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), str(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_decided_one_by_one(spark, make, tmp_path):
    bench = spark.createDataFrame([(1, "vier kleine katzen sitzen dort")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a first text", "en"), (None, "another one, clean", "en"), (3, "a first text", "en"), (5, "a first text", "en"),
            (5, "only here, under an id given twice", "en"), (8, "said twice", "en"), (8, "said twice", "en"), (8, "said  twice", "en"),
            (None, "vier kleine katzen sitzen dort", "de")]
    docs = make(rows)

    def left(stage, docs):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    clean = [(None, "another one, clean"), (3, "a first text"), (5, "only here, under an id given twice")]
    leak = (None, "vier kleine katzen sitzen dort")
    assert left(corpus_pipeline.exact_dedup, docs) == sorted([*clean, (8, "said  twice"), leak], key=str)
    assert left(corpus_pipeline.simhash_dedup, docs) == sorted([*clean, (8, "said twice"), leak], key=str)
    assert left(corpus_pipeline.decontamination, docs) == sorted([(i, t) for i, t, _ in rows[:-1]], key=str)
    # From files, in several partitions, and with a column named as the key.
    docs.withColumnRenamed("key", "_row").repartition(3).write.parquet(f"{tmp_path}/docs.parquet")
    read = spark.read.parquet(f"{tmp_path}/docs.parquet")
    assert corpus_pipeline.exact_dedup(spark, read, str(tmp_path)).columns == read.columns
    assert [t for _, t in left(corpus_pipeline.exact_dedup, read) if "twice" in t and "said" in t] == ["said  twice"]


def test_five_stages_recomputed_plainly(spark):
    """The whole run on the smallest given table, each stage in plain Python."""
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    model = langid.learn(table, fold("doc_id", 3) != 1)
    langs, scores = langid.predict(model, [t for _, t, _ in docs])
    kept = [x for x, lang, score in zip(docs, langs, scores, strict=True) if lang != "und" and score > 0]

    def first_of(rows, group, rank):
        best = {}
        for x in sorted(rows, key=rank):
            best.setdefault(group(x), x)
        return list(best.values())

    blank = str.maketrans("", "", " \t\n\x0b\x0c\r")
    kept = first_of(kept, lambda x: x[1].translate(blank), lambda x: (-len(x[1]), x[0]))
    prints = {x[0]: simhash.fingerprint(x[1], 4) for x in kept}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = first_of(kept, lambda x: find(x[0]), lambda x: x[0])
    windows = {w for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in decontam.windows_of(decontam.words_of(r["text"]), 10)}
    lengths = {len(w) for w in windows}

    def leaks(text):
        words = decontam.words_of(text)
        return any(tuple(words[i:i + n]) in windows for n in lengths for i in range(len(words) - n + 1))

    kept = [x for x in kept if not leaks(x[1])]
    encode = Tokenizer.from_file(queries.tokenizer_path(queries.PACK_TOKENIZER)).encode
    want = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in kept}
    pieces = corpus_pipeline.run(spark, d).collect()
    got = defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert p["doc_tokens"] == want[p["doc_id"]]
    assert dict(got) == want and 0 < len(want) < len(docs)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(spans))]
        assert [a for a, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 4096


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_row_keys_need_no_python_on_the_executors(make, tmp_path):
    make([(i, "a b", "en") for i in range(4)]).repartition(3).write.parquet(str(tmp_path / "docs"))
    rows = common.Rows(make([]).sparkSession.read.parquet(str(tmp_path / "docs")))
    for frame in (rows.frame(), rows.frame(range(1, 2))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "RDD" not in plan
    assert rows.frame().select(rows.name).distinct().count() == 4


def test_a_worker_keeps_the_tables_of_one_operator():
    ids = packing._ids(tokenizer_path(PACK_TOKENIZER))
    assert packing._ids(tokenizer_path(PACK_TOKENIZER)) is ids
    held = weakref.ref(ids)
    del ids
    tests = SimpleNamespace(value=[("i", "one two three")])
    batch = pd.DataFrame({"id": [1], "text": ["zero one two three"]})
    found = list(decontam._search(tests, "t", 10, True)(iter([batch])))
    gc.collect()
    assert held() is None and found[0]["items"].tolist() == [["i"]]
    common.release()
    assert not common._held
