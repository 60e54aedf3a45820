"""Personal data by patterns and by information-theoretic sanitisation. DataFrame
functions only.

1. Base spans: e-mail, IP, card (Luhn) and phone patterns, leftmost and not
   overlapping within a kind. The patterns used here start only where a run of
   their characters starts and never give characters back, so a text of one long
   run costs one pass; they find what the plain patterns find. Places are code
   points: a text is split at the matches and the lengths are added up.
2. Corpus statistics, over all rows: for every protected entity (a kind's value,
   without case and punctuation) the rows that hold it; for every term (a word
   wholly within ``reach`` code points of one of its spans) the rows where the two
   stand so together, and the number of different surroundings they were seen in,
   so that copies of one passage are one piece of evidence; for every word the
   rows that hold it.
3. A term discloses an entity if their pointwise mutual information,
   log2(rows * n(e, t) / (n(e) * n(t))), is at least ``share`` of the entity's
   own information, log2(rows / n(e)), and at least log2(``lift``), over
   ``contexts`` surroundings or more. So neither a frequent entity (a site's contact address)
   nor a frequent word is touched.
4. Disclosing terms become spans of kind ``term`` wherever they stand, outside
   base spans. ``sanitised`` replaces base spans by their kind, and generalises a
   term to its first ``HEAD`` letters, if some word that begins so is too frequent
   to disclose anything, or else removes it.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
ASCII. Texts move between tasks only if they hold a disclosing term, and only if
there are too many of these texts to broadcast their keys (a counted limit).

Defined cases: null text is empty; empty texts have no spans; repeated rows each
get a row and count as rows each; a null id is passed on; without any base span,
or with an empty table, there are no terms; other columns are not read (in
``sanitised``: passed on). A text's spans are put together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]++"
PATTERNS = {
    # The start of a run, or where the last match ended inside one.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # A whole chain of 14 to 19 digits with single blanks or hyphens between.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    # 10 to 15 digits up to the last one of the run.
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9,14}+(?![\x20().-]*+[0-9])",
}
#: Letters of a term's general form.
HEAD = 3
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _places(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, begin, step, lambda acc: acc["spans"])


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, n: a + n) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (place in KINDS), end, value>>, sorted."""
    def of(kind: str) -> Column:
        spans = _places(text, F.lit(PATTERNS[kind]))
        if kind == "ip":
            spans = F.filter(spans, lambda s: s["value"].rlike(rf"\A{_BYTE}(\.{_BYTE}){{3}}\z"))
        if kind == "card":
            spans = F.filter(spans, lambda s: _luhn(s["value"]))
        # The cheap test spares most texts the pattern.
        may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
        out = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(may, out).otherwise(F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>"))

    return F.sort_array(F.concat(*map(of, PATTERNS)))


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lowered(text), f"{_NOT_WORD}+"), lambda w: w != ""))


def _entity(s: Column) -> Column:
    value = F.when(s["kind"] == 0, _lowered(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.concat(s["kind"].cast("string"), F.lit(":"), value)


def _surroundings(text: Column, s: Column, reach: int) -> Column:
    """What stands within ``reach`` code points of a span, one more character
    each way deciding whether the outermost word is whole."""
    low = F.greatest(F.lit(0), s["start"] - (reach + 1))
    left = F.substr(text, low + 1, s["start"] - low)
    left = F.when(s["start"] > reach, F.regexp_replace(left, f"^{_WORD}+", "")).otherwise(left)
    right = F.substr(text, s["end"] + 1, F.lit(reach + 1))
    right = F.when(F.length(right) > reach, F.regexp_replace(right, f"{_WORD}+$", "")).otherwise(right)
    return F.concat(left, F.lit(" "), right)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 60) -> DataFrame:
    """One narrow row per row: id, key (128 bits of the text's SHA-256), base
    (spans without values), near (entity, surroundings, hash of them)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))

    def near(s: Column) -> Column:
        around = _surroundings(_lowered(F.col("text")), s, reach)
        return F.struct(_entity(s).alias("entity"), F.array_distinct(F.filter(F.split(around, f"{_NOT_WORD}+"), lambda w: w != "")).alias("words"),
                        F.xxhash64(around).alias("around"))

    return rows.select("id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("key"),
                       F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
                       F.transform("spans", near).alias("near"))


def disclosing_terms(docs: DataFrame, scan: DataFrame, share: float, lift: float, contexts: int, text_col: str = "text") -> DataFrame:
    """(word, general): terms that disclose some entity, and the first letters
    that may stand for them (null: none may). ``scan`` is the written ``scanned``."""
    total = scan.count()
    seen = scan.where(F.size("near") > 0).select("near")
    held = (seen.select(F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"]))).alias("entity"))
            .groupBy("entity").agg(F.count("*").alias("n_e")))
    each = F.flatten(F.transform("near", lambda n: F.transform(n["words"], lambda w: F.struct(n["entity"].alias("entity"), w.alias("word"), n["around"].alias("around")))))
    met = seen.select(F.posexplode(F.array_sort(F.array_distinct(each))).alias("i", "m"), F.array_sort(F.array_distinct(each)).alias("all"))
    # A row counts once for a pair, however many surroundings of it it holds.
    first = (F.col("i") == 0) | (F.get("all", F.col("i") - 1)["entity"] != F.col("m.entity")) | (F.get("all", F.col("i") - 1)["word"] != F.col("m.word"))
    pairs = (met.select("m.entity", "m.word", "m.around", first.cast("long").alias("first"))
             .groupBy("entity", "word", "around").agg(F.sum("first").alias("n"))
             .groupBy("entity", "word").agg(F.sum("n").alias("n_et"), F.count("*").alias("seen")).where(F.col("seen") >= contexts))
    pairs = written(pairs.join(held, "entity"), "pii-pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "word string, general string")
    vocabulary = written(docs.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n_t")), "pii-words")
    information = F.log2(F.lit(total) / F.col("n_e"))
    shared = F.log2(F.lit(total) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    limit = F.greatest(F.lit(share) * information, F.log2(F.lit(lift)))
    lifted = F.lit(float(total)) * F.col("n_et") >= F.lit(float(lift)) * F.col("n_e") * F.col("n_t")
    strong = (pairs.join(vocabulary, "word").where(lifted & (shared >= F.lit(share) * information))
              .groupBy("word").agg(F.min(limit).alias("limit")))
    # PMI with a prefix is at most log2(rows / rows of any word that begins so).
    head = F.when(F.length("word") > HEAD, F.substring("word", 1, HEAD))
    often = vocabulary.groupBy(head.alias("head")).agg(F.max("n_t").alias("n_h"))
    strong = strong.withColumn("head", head).join(often, "head", "left")
    general = F.when(F.log2(F.lit(total) / F.col("n_h")) < F.col("limit"), F.col("head"))
    return written(strong.select("word", general.alias("general")), "pii-terms")


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, found): for texts with disclosing terms, their places and values."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.substring(F.sha2(text.cast("binary"), 256), 1, 32)
    words = docs.select(key.alias("key"), F.explode(_words(text)).alias("word"))
    held = written(words.join(if_small(terms.select("word")), "word", "left_semi").groupBy("key").agg(F.collect_set("word").alias("words")), "pii-texts")
    # A word holds no ASCII mark, so nothing in it has a meaning in a pattern.
    pattern = F.concat(F.lit(f"(?<!{_WORD})(?:"), F.array_join("words", "|"), F.lit(f")(?!{_WORD})"))
    texts = docs.select(key.alias("key"), _lowered(text).alias("text")).join(if_small(held), "key").dropDuplicates(["key"])
    return texts.select("key", _places(F.col("text"), pattern).alias("found"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 60, share: float = 0.9, lift: float = 64.0,
         contexts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): one row per row of ``docs`` with id, key, base spans and
    all spans (start, kind, end, value of terms), and the disclosing terms."""
    scan = written(scanned(docs, id_col, text_col, reach), "pii-scan")
    terms = disclosing_terms(docs, scan, share, lift, contexts, text_col)
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("value")))
    if terms.isEmpty():
        return scan.select("id", "key", "base", plain.alias("spans")), terms
    found = written(term_spans(docs, terms, text_col), "pii-found")

    def apart(t: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    more = F.transform(F.filter(F.coalesce("found", F.array().cast("array<struct<start: int, end: int, value: string>>")), apart),
                       lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), t["end"].alias("end"), t["value"].alias("value")))
    rows = scan.join(if_small(found), "key", "left")
    return rows.select("id", "key", "base", F.sort_array(F.concat(plain, more)).alias("spans")), terms


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("id").alias(id_col), *map(count, PATTERNS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                       listed("spans").alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the text (null as empty) sanitised: base spans become
    ``[EMAIL]`` and so on, terms their general form or nothing."""
    rows, terms = find(docs, id_col, text_col, **limits)
    known = terms.where("general is not null").select(F.col("word").alias("value"), "general")
    hit = rows.where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    each = hit.select("key", F.explode("spans").alias("s")).select("key", "s.*").join(if_small(known), "value", "left")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    becomes = F.when(F.col("kind") < KINDS.index("term"), F.get(kinds, F.col("kind"))).otherwise(F.coalesce(F.concat("general", F.lit("*")), F.lit("")))
    swaps = written(each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", becomes.alias("becomes")))).alias("swaps")), "pii-swaps")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        # A span that begins inside the last one only lengthens it.
        inside = s["start"] < acc["at"]
        piece = F.when(inside, "").otherwise(F.concat(F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), s["becomes"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["text"], piece).alias("text"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    rest = F.aggregate("swaps", begin, step, lambda acc: F.concat(acc["text"], F.substr(text, acc["at"] + 1, F.length(text))))
    key = F.substring(F.sha2(text.cast("binary"), 256), 1, 32)
    joined = docs.join(if_small(swaps.withColumnRenamed("key", "_key")), key == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_key").isNull(), text).otherwise(rest).alias(c) if c == text_col else docs[c] for c in docs.columns])
