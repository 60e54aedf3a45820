from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from marquee.llm import personal_sql, sanitise
from tests.llm.conftest import ODD

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(digits)) % 10 == 0


def base(text):
    def fits(kind, value):
        n = sum(c.isdigit() for c in value)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 14 <= n <= 19 and luhn(value), "phone": 10 <= n <= 15}[kind]
    return sorted((m.start(), k, m.end(), m[0]) for k, (kind, p) in enumerate(RAW.items()) for m in re.finditer(p, text) if fits(kind, m[0]))


def entity(k, value):
    return f"{k}:" + (value.translate(LOWER) if k == 0 else value if k == 1 else re.sub("[^0-9]", "", value))


def plain(texts, reach=60, share=0.9, lift=64.0, contexts=3):
    """Spans by text, and the terms, counted in plain Python."""
    rows_et, seen, n_e, n_t = defaultdict(set), defaultdict(set), defaultdict(set), Counter()
    for i, text in enumerate(texts):
        low = text.translate(LOWER)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD, low)]
        n_t.update({w for _, _, w in words})
        for start, k, end, value in base(text):
            e = entity(k, value)
            n_e[e].add(i)
            left, right = low[max(0, start - reach):start], low[end:end + reach]
            around = [w for s, t, w in words if start - reach <= s and t <= start or end <= s and t <= end + reach]
            # Words cut by the span itself.
            around = set(re.findall(WORD, left if start - reach <= 0 or not re.match(WORD, low[start - reach - 1]) else re.sub(f"^{WORD}", "", left)))
            around |= set(re.findall(WORD, right if end + reach >= len(low) or not re.match(WORD, low[end + reach]) else re.sub(f"{WORD}$", "", right)))
            for w in around:
                rows_et[e, w].add(i)
                seen[e, w].add((left, right))
    n = len(texts)
    terms = {w for (e, w), rows in rows_et.items() if len(seen[e, w]) >= contexts and n * len(rows) >= lift * len(n_e[e]) * n_t[w]
             and math.log2(n * len(rows) / (len(n_e[e]) * n_t[w])) >= share * math.log2(n / len(n_e[e]))}
    out = []
    for text in texts:
        found = base(text)
        more = [(m.start(), 4, m.end(), m[0]) for m in re.finditer(WORD, text.translate(LOWER)) if m[0] in terms]
        out.append(sorted(found + [m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in found)]))
    return out, terms


def corpus():
    """Texts in which a few unusual words keep company with one address."""
    rng = random.Random(4)
    common = ["the", "of", "and", "house", "river", "Über", "blue", "walks", "quickly", "漢字", "is", "near"]

    def some(n):
        return " ".join(rng.choice(common) for _ in range(n))

    texts = [some(rng.randint(0, 40)) for _ in range(300)]
    texts += [f"{some(9)} Zaphod {some(rng.randint(1, 4))} zb@Example.com {some(rng.randint(1, 5))} trillian, {some(9)}" for _ in range(4)]
    texts += [f"{some(20)} zaphod again, without an address", "Zaphods is another word; zaphod-like is two"]
    texts += [f"{some(3)} marvin {some(2)} 4337 1665 9846 4399 {some(5)}"] * 5  # copies are one surrounding
    texts += [f"{some(3)} contact us at info@site.org {some(rng.randint(1, 9))}" for _ in range(200)]  # too frequent to disclose
    return texts


def tricky(n):
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x.y", "-", " ", "  ", ".", "+", "+1", "(", "123", "4", "4337166598464399", "255", "256", "1.2.3.4", ".5", "0", "00", "é", "漢",
             "\U0001f600", "\n", "%", "_", "a@b.c", "9" * 12, "-5", "\x0c", "A"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


LONG = ["x" * 100_000, "1" * 100_000, "1 " * 50_000, "a.b" * 30_000 + "@", "+1" + " " * 100_000, "a@b" + ".c" * 50_000, "1.1" * 30_000, "+1" * 50_000, "a@b.c " * 1000]


def frame(spark, texts):
    rows = [(i, t, "e", 1, "k", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, entity string, id long, key string, base double").repartition(5)


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = tricky(3000) + LONG
    got = {r["id"]: [tuple(s) for s in r["base"]] for r in sanitise.scanned(frame(spark, texts)).select("id", "base").collect()}
    assert got == {i: [s[:3] for s in base(t)] for i, t in enumerate(texts)}


def test_terms_against_plain_counts(spark):
    texts = corpus()
    want, terms = plain(texts)
    assert {"zaphod", "trillian"} == terms
    rows, found = sanitise.find(frame(spark, texts))
    assert {r["word"] for r in found.collect()} == terms
    got = {r["id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in rows.collect()}
    assert got == {i: [s[:3] for s in w] for i, w in enumerate(want)}
    one = next(r for r in sanitise.digest(rows).collect() if r["doc_id"] == 300)
    names = [f"{sanitise.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in want[300]]
    assert one["spans"] == ",".join(names) and one["n_email"] == 1
    assert one["base_sha256"] == hashlib.sha256(",".join(x for x in names if not x.startswith("term")).encode()).hexdigest()


def test_sql_says_the_same(spark, tmp_path):
    texts = corpus() + tricky(400)
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(personal_sql.SANITISE).fetchall())
    assert sorted(tuple(r) for r in sanitise.digest(sanitise.find(docs)[0]).collect()) == want


def test_sanitised_texts(spark):
    texts = corpus()
    out = {r["doc_id"]: r for r in sanitise.sanitised(frame(spark, texts)).collect()}
    assert out[300].asDict().keys() == {"doc_id", "text", "entity", "id", "key", "base"}
    want, _ = plain(texts)
    for i, text in enumerate(texts):
        at, pieces = 0, []
        for start, kind, end, _ in want[i]:
            pieces += [text[at:start], f"[{sanitise.KINDS[kind].upper()}]" if kind < 4 else ""]
            at = end
        assert out[i]["text"] == "".join(pieces) + text[at:]
    # A frequent word that begins as the term lets its head stay.
    wider = [t + " zapper" for t in texts]
    assert " zap* " in {r["doc_id"]: r["text"] for r in sanitise.sanitised(frame(spark, wider)).collect()}[300]


def test_odd_rows(spark, make):
    got = sanitise.digest(sanitise.find(make(ODD))[0]).collect()
    assert len(got) == len(ODD) and all(r["spans"] == "" for r in got)
    assert sanitise.digest(sanitise.find(make([]))[0]).count() == 0
    assert sanitise.sanitised(make([])).count() == 0
    again = sanitise.digest(sanitise.find(make([(None, "a@b.c", None), (1, None, None), (1, "a@b.c", None), (1, "a@b.c", None)]))[0]).collect()
    assert sorted(str(r["doc_id"]) + r["spans"] for r in again) == ["1", "1email:0:5", "1email:0:5", "Noneemail:0:5"]


def test_whole_plan_is_native(spark):
    docs = frame(spark, corpus())
    rows, _ = sanitise.find(docs)
    plan = sanitise.digest(rows)._jdf.queryExecution().toString() + sanitise.scanned(docs).select(F.col("near"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
