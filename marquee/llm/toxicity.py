"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams, backed off to the bigrams and unigrams
   that they sum to) is counted by Spark over the words of all texts of the corpus, whole.
2. A token with digits or marks among letters, a run of single characters, or a
   letter three times in a row is a suspect. Its lattice holds, per
   character, the letters it may stand for (itself, leetspeak readings), or
   nothing (a separator, a repeat), each with a channel cost; the Viterbi path
   under the language model is the restored word. A second lattice may also end
   a word at a separator or before a letter, and gives the words of a phrase
   spaced out or joined. Restored words are added to the words of the text, so
   an honest word that merely looks odd costs nothing.
3. Each restored word has an evidence weight: the smoothed log ratio of its
   document frequencies in toxic and other learning rows, all counted by Spark. A word counts only if it is in at least ``min_docs`` toxic
   learning rows and holds in each of two halves of the learning rows (near copies share one). Starts
   of words (4 and 6 letters) count as words, too. The score is the toxic share
   of the learning rows with as much evidence (each half judged by the other
   half's), smoothed and made monotone. Labels meet texts where these are read, and
evidence goes out as hashes and weights, so no text is shuffled.

Defined cases: null, empty and wordless texts have no evidence and get the base
rate of texts without any; labels whose toxic mark is null are not learned
from; repeated label rows of one id count once, the larger mark winning; a null
id is held out; without any positive row all scores are the base rate (0
without any row); repeated rows each get a row; an empty table gives an empty
result. No other column is read.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Marks, Recent, Rows, free_name, python_batches, scratch, text_runs, written
from .langid import folded, summed

#: What a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "×": "x",
}
#: Characters that may stand for nothing inside a word.
SEPARATORS = "*.-_~^'`,:;/\\|+=#%&"
_WORD = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Marks at the end of a token that hide nothing.
_TAIL = "*.-_~^'`,:;/\\|+=#%&!?$@"
_EDGE = ".,:;?\"'()[]{}…"
#: Costs (natural logs) of the channel.
SUBSTITUTE, DROP, REPEAT, PAIR, BREAK = 1.0, 0.7, 0.5, 2.5, 0.7
#: Words, or tokens, that a task holds before it hands their counts to Spark.
HELD = 300_000
#: Characters of texts that are looked at together.
_RUN = 1 << 21
_COUNTS = ("neg0", "pos0", "neg1", "pos1")


@dataclass(frozen=True)
class CharModel:
    """log P(c | a b) over lower-case words with a blank on each side."""
    tri: dict[str, int] | Cells
    bi: dict[str, int] | Cells
    uni: dict[str, int]
    total: int
    costs: Recent = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "costs", Recent(self._cost, 16 << 20))

    def __reduce__(self):
        return CharModel, (self.tri, self.bi, self.uni, self.total)

    def cost(self, a: str, b: str, c: str) -> float:
        return self.costs[a + b + c]

    def _cost(self, gram: str) -> float:
        a, b, c = gram
        bi, uni = self.bi.get(a + b, 0), self.uni.get(b, 0)
        p = (self.uni.get(c, 0) + 1) / (self.total + 1000)
        p = (self.bi.get(b + c, 0) + 5 * p) / (uni + 5)
        return -math.log((self.tri.get(gram, 0) + 5 * p) / (bi + 5))


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, c, n): how often letter c follows a and b (code points), over the
    lower-cased words of all texts, two blanks before and one behind each."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            held += [np.unique(trigrams(texts[i:j]), return_counts=True) for i, j in text_runs(texts, 1 << 19)]
            held = [summed(held)] if held else []
        for gram, n in held:
            part = [(gram >> np.uint64(s) & np.uint64(0x1FFFFF)).astype(np.int64) for s in (42, 21, 0)]
            yield pd.DataFrame(dict(zip("abc", part, strict=True)) | {"n": n})

    return (docs.select(F.col(text_col).alias("text")).mapInPandas(run, "a long, b long, c long, n long")
            .groupBy("a", "b", "c").agg(F.sum("n").alias("n")))


def trigrams(texts: list[str]) -> np.ndarray:
    """Three code points of 21 bits for every letter and every word's end."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = folded()[points]
    keep = low != 32
    keep[1:] |= keep[:-1].copy()  # one blank behind each word
    low = np.concatenate([np.full(2, 32, np.uint32), low[keep]]).astype(np.uint64)
    a, b, c = low[:-2], low[1:-1], low[2:]
    return np.where(b == 32, np.uint64(32), a) << np.uint64(42) | b << np.uint64(21) | c


class Cells:
    """Counts of more n-grams than a dict should hold, each n-gram by itself:
    sorted keys of 21 bits a code point, and counts; 16 bytes an n-gram. They
    come to the driver in slices of about ``SLICE`` n-grams."""

    SLICE = 2_000_000

    def __init__(self, grams: DataFrame, n: int, *points: str):
        """``grams``: n different n-grams of ``points``, and their counts ``n``."""
        key = F.lit(0).cast("long")
        for p in points:
            key = F.shiftleft(key, 21).bitwiseOR(F.col(p).cast("long"))
        rows, parts = grams.select(key.alias("key"), F.col("n").cast("long").alias("n")), n // self.SLICE + 1
        keys, counts, at = np.empty(n, np.int64), np.empty(n, np.int64), 0
        for i in range(parts):
            got = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).toArrow()
            for into, name in ((keys, "key"), (counts, "n")):
                into[at:at + len(got)] = got[name].to_numpy()
            at += len(got)
        order = np.argsort(keys)
        self.key = keys[order]
        del keys
        self.n = counts[order]

    def _at(self, gram: str) -> tuple[int, int, bool]:
        key = 0
        for c in gram:
            key = key << 21 | ord(c)
        at = int(np.searchsorted(self.key, np.int64(key)))
        return key, at, at < len(self.key) and int(self.key[at]) == key

    def get(self, gram: str, default: int = 0) -> int:
        _, at, found = self._at(gram)
        return int(self.n[at]) if found else default

    def __setitem__(self, gram: str, n: int) -> None:
        key, at, found = self._at(gram)
        if found:
            self.n[at] = n
        else:
            self.key, self.n = np.insert(self.key, at, key), np.insert(self.n, at, n)


def _counted(counts: DataFrame, exact: int, *points: str) -> dict[str, int] | Cells:
    """The sums of ``n`` by the n-gram of ``points``, all of them: a dict of up to
    ``exact`` n-grams, else the smaller cells; the counts are the same."""
    grams = counts.groupBy(*points).agg(F.sum("n").alias("n"))
    if len(points) > 1 and (n := grams.count()) > exact:
        return Cells(grams, n, *points)
    return {"".join(map(chr, row[:-1])): row[-1] for row in grams.toPandas().itertuples(index=False, name=None)}


def char_model(counts: DataFrame, exact: int = 200_000) -> CharModel:
    """The model of all trigrams, each counted by itself; the shorter counts are
    their sums. ``exact`` says how they are held and changes no cost."""
    tri, bi, uni = (_counted(counts, exact, *points) for points in ("abc", "bc", "c"))
    bi["  "] = uni.get(" ", 0)  # a word begins wherever one ended
    return CharModel(tri, bi, uni, sum(uni.values()))


def restore(run: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest letters behind a run of characters, by Viterbi over the
    last two letters; '' if nothing in it can be a letter. With ``breaks``, a
    word may end at a separator, at a blank or before any letter, and the words
    found stand apart by one blank."""
    paths: dict[tuple[str, str, str], tuple[float, tuple | None]] = {(" ", " ", ""): (0.0, None)}
    for i, ch in enumerate(run):
        options = [(c, SUBSTITUTE) for c in LEET.get(ch, "")]
        if ch.isalpha():
            options.append((ch, 0.0))
        parts = ch in SEPARATORS or ch.isspace()
        drop = DROP if parts else None if options else 0.0
        step: dict[tuple[str, str, str], tuple[float, tuple | None]] = {}

        def offer(key, cost, text):
            if key not in step or cost < step[key][0]:
                step[key] = (cost, text)

        tripled = i + 1 < len(run) and run[i + 1] == ch or i > 1 and run[i - 2] == ch
        for (a, b, raw), (cost, text) in paths.items():
            for c, price in options:
                offer((b, c, ch), cost + price + model.cost(a, b, c), (text, c))
            if drop is not None:
                offer((a, b, raw), cost + drop, text)
            if ch == raw and options:
                offer((a, b, raw), cost + (REPEAT if tripled else PAIR), text)
            if breaks and b != " ":
                ended = cost + model.cost(a, b, " ")
                if parts or ch in LEET and not ch.isalnum():
                    offer((" ", " ", ""), ended, (text, " "))
                for c, price in options:
                    offer((" ", c, ch), ended + BREAK + price + model.cost(" ", " ", c), ((text, " "), c))
        paths = step

    def spelt(link):
        letters = []
        while link:
            link, c = link
            letters.append(c)
        return "".join(reversed(letters)).strip()

    return min((cost + (model.cost(a, b, " ") if b != " " or not breaks else 0.0), spelt(text)) for (a, b, _), (cost, text) in paths.items())[1]


def readings(run: str, model: CharModel) -> set[str]:
    """The words behind a run: read as one word, and as several."""
    return {restore(run, model), *restore(run, model, breaks=True).split()}


def suspects(token: str) -> set[str]:
    """Parts of a lower-case token that may hide a word."""
    if token.isalpha():
        return {token} if _TRIPLE.search(token) else set()
    core = token.strip(_EDGE)
    head = core.rstrip(_TAIL)
    parts = {head}
    if 0 < len(core) - len(head) <= 2 and core[-1] in "$@":
        parts.add(core)
    return {p for p in parts if sum(map(str.isalpha, p)) > 1 and (not p.isalpha() or _TRIPLE.search(p))}


def plain(token: str) -> str:
    """The word of a token that is one and hides none; '' for other tokens."""
    core = token.strip(_EDGE)
    if not core.isalpha():
        return ""
    # A letter three times leaves two letters fewer.
    return "" if len(core) - len(set(core)) > 1 and _TRIPLE.search(core) else core


def told_apart(tokens: Collection[str]) -> tuple[list[str], list[str], list[str]]:
    """Tokens that are a word and hide none, the words of these (as ``plain``),
    and the other tokens."""
    cores = [t.strip(_EDGE) for t in tokens]
    own = np.fromiter(map(str.isalpha, cores), bool, len(cores))
    words = list(compress(cores, own))
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    again = points[1:] == points[:-1]
    triples = np.flatnonzero(again[1:] & again[:-1])
    if len(triples):
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        own[np.flatnonzero(own)[np.unique(np.searchsorted(ends, triples, "right"))]] = False
        words = list(compress(cores, own))
    return list(compress(tokens, own)), words, list(compress(tokens, ~own))


def with_starts(words: set[str]) -> set[str]:
    """The words and, marked, their first 4 and 6 letters."""
    return {w for w in words if w} | {"^" + w[:n] for w in words for n in (4, 6) if len(w) > n}


class Restorer:
    """Words of texts, the restored among them, through a cache by token."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known = Recent(self.token, 48 << 20)

    def __reduce__(self):
        return Restorer, (self.model,)

    def token(self, token: str) -> tuple[str, ...]:
        if core := plain(token):
            return tuple(with_starts({core}))
        found = set(_WORD.findall(token)).union(*[readings(p, self.model) for p in suspects(token)])
        return tuple(with_starts(found))

    def spaced(self, tokens: list[str]) -> Iterator[str]:
        """Words spelt as three or more tokens of one character each, also
        without the first or the last."""
        if list(map(len, tokens)).count(1) < 3:
            return
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        at = 0
        while at < len(single):
            end = at + 1
            while end < len(single) and single[end] == single[end - 1] + 1:
                end += 1
            if end - at > 2:
                run = "".join(tokens[single[at]:single[end - 1] + 1])
                if len(set(run)) > 1:
                    for r in (run, run[1:], run[:-1]):
                        yield from readings(r, self.model)
            at = end

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        tokens = text.lower().split()
        found: set[str] = set()
        for t in set(tokens):
            found.update(self.known[t])
        return found | with_starts(set(self.spaced(tokens)))


def tokens_of(texts: list[str]) -> Iterator[tuple[range, list[list[str]], list[set[str]], set[str]]]:
    """Runs of texts: their places, each text's tokens, its different tokens, and
    the different tokens of the run."""
    for i, j in text_runs(texts, _RUN):
        tokens = [t.lower().split() for t in texts[i:j]]
        different = list(map(set, tokens))
        yield range(i, j), tokens, different, set().union(*different)


class WordCounts:
    """How many texts of each of four groups have a word ('' stands for every
    text), by numbered words, so that a token is taken apart once."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # the next number
        self.n = np.zeros((4, self.number[""] + 1), np.int64)
        self.of: dict[str, tuple[int, ...]] = {}  # token -> its words

    def full(self) -> bool:
        return max(len(self.number), len(self.of)) > HELD

    def _learn(self, tokens: Collection[str]) -> None:
        """As ``Restorer.token``."""
        number, of = self.number, self.of
        own, words, others = told_apart(tokens)
        for t, w in zip(own, words, strict=True):
            if len(w) > 6:
                of[t] = number[w], number["^" + w[:4]], number["^" + w[:6]]
            elif len(w) > 4:
                of[t] = number[w], number["^" + w[:4]]
            else:
                of[t] = (number[w],)
        for t in others:
            of[t] = tuple(map(number.__getitem__, self.restorer.known[t]))

    def add(self, texts: list[str], groups: list[int]) -> None:
        seen: list[list[int]] = [[] for _ in range(4)]
        for at, tokens, different, every in tokens_of(texts):
            self._learn(every.difference(self.of))
            for i, row, own in zip(at, tokens, different, strict=True):
                found = set(chain.from_iterable(map(self.of.__getitem__, own)))
                found.update(map(self.number.__getitem__, with_starts(set(self.restorer.spaced(row)))))
                seen[groups[i]] += found
                seen[groups[i]].append(0)
        n = np.stack([np.bincount(np.array(s, np.int64), minlength=len(self.number)) for s in seen])
        n[:, :self.n.shape[1]] += self.n
        self.n = n

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"word": list(self.number)} | dict(zip(_COUNTS, self.n, strict=True)))


def least_shingle(text: str | None) -> int:
    """The least hash of a text's three-word shingles, as a signed long."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    return min(map(xxh64_intdigest, shingles)) - (1 << 63)


def half_of(text: str | None) -> int:
    """0 or 1, by the least hash of the three-word shingles, so most copies with
    few changes fall into one half: otherwise the words of a text that was copied
    often would pass for evidence."""
    return least_shingle(text) >> 7 & 1


@dataclass(frozen=True)
class Model:
    restorer: Restorer
    evidence: DataFrame  # h (XXH64 of the word, as a signed long), w, views
    blocks: int
    table: tuple[float, ...]  # score by evidence cell


#: Who may use a word of evidence, as bits: learning rows of half 0 (the word
#: holds in half 1), of half 1, and all other rows (it holds in both).
OTHERS = 2


class Without:
    """Tokens known to have no evidence, in two generations of about ``most``
    bytes each; those met again move up."""

    def __init__(self, most: int = 40 << 20):
        self.most, self.size, self.now, self.old = most, 0, set(), set()

    def add(self, tokens: set[str]) -> None:
        self.size += 110 * len(tokens) + 2 * sum(map(len, tokens))
        self.now |= tokens
        if self.size > self.most:
            self.now, self.old, self.size = set(), self.now, 0

    def others(self, tokens: set[str]) -> set[str]:
        """The tokens that are not known."""
        rest = tokens - self.now
        again = rest & self.old
        rest -= again
        self.add(again)
        return rest


class Finder:
    """Evidence in texts: 17 bytes a word, sorted by the word's hash."""

    def __init__(self, restorer: Restorer, h: np.ndarray, w: array, views: bytes):
        self.restorer, self.h, self.w, self.views = restorer, h, w, views
        self.without = Without()

    def __reduce__(self):
        return Finder, (self.restorer, self.h, self.w, self.views)

    def _places(self, words: Collection[str]) -> dict[str, int]:
        """The places in the evidence of the words that are there."""
        h = np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        there = self.h[at] == h
        return dict(zip(compress(words, there), at[there].tolist(), strict=True))

    def _of_tokens(self, tokens: Collection[str]) -> dict[str, set[int]]:
        """The evidence of the tokens that have any (as ``Restorer.token``)."""
        own, words, others = told_apart(tokens)
        starts = {"^" + w for w in {w[:4] for w in words if len(w) > 4} | {w[:6] for w in words if len(w) > 6}}
        hidden = {t: self.restorer.known[t] for t in others}
        places = self._places({*words, *starts, *chain.from_iterable(hidden.values())})
        begin = {w[1:] for w in places if w[0] == "^"}
        found = {t: {places[x] for x in with_starts({w}) if x in places} for t, w in zip(own, words, strict=True)
                 if w in places or w[:4] in begin or w[:6] in begin}
        found |= {t: {places[x] for x in words if x in places} for t, words in hidden.items()}
        return {t: at for t, at in found.items() if at}

    def strongest(self, texts: list[str], views: list[int]) -> list[list[float]]:
        """For each text, the three largest weights of its words, rising, for
        its view."""
        if not len(self.h):
            return [[] for _ in texts]
        best = []
        for at, tokens, different, every in tokens_of(texts):
            new = self.without.others(every)
            evidence = self._of_tokens(new)
            marked = set(evidence)
            self.without.add(new - marked)
            for i, row, own in zip(at, tokens, different, strict=True):
                found = set().union(*map(evidence.__getitem__, own & marked))
                if hidden := with_starts(set(self.restorer.spaced(row))):
                    found.update(self._places(hidden).values())
                best.append(sorted(self.w[p] for p in found if self.views[p] >> views[i] & 1)[-3:])
        return best


def finder(restorer: Restorer, evidence: DataFrame, block: int = 0, blocks: int = 1) -> Broadcast:
    """A block of the evidence (by hash; a bounded number of words), broadcast."""
    part = evidence.where(F.pmod("h", F.lit(blocks)) == block).select("h", "w", "views").toPandas()
    h = part["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    words = Finder(restorer, h[order], array("d", part["w"].to_numpy(float)[order].tobytes()),
                   part["views"].to_numpy(np.uint8)[order].tobytes())
    return evidence.sparkSession.sparkContext.broadcast(words)


#: Cell 0 has no evidence; the others, the whole part of the three strongest
#: weights' sum.
N_CELLS = 22


def rising(n: list[float], pos: list[float]) -> list[float]:
    """Shares pos / n, neighbours pooled until they rise."""
    pools: list[list[float]] = []
    for a, b in zip(n, pos, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
            a2, b2, k = pools.pop()
            pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2] + k]
    return [b / a for a, b, k in pools for _ in range(int(k))]


def learn(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", min_docs: int = 6, block_words: int = 2_000_000, entries: int = 1_000_000) -> Model:
    """Learns from the labelled rows where ``use`` (over the id) holds. Labels go
    to the rows where they are read (``Marks``, ``entries``); no text is shuffled."""
    spark = docs.sparkSession
    python_batches(spark)
    restorer = Restorer(char_model(written(char_counts(docs, text_col), "toxic-grams")))
    shared = spark.sparkContext.broadcast(restorer)
    marks = (labels.where(use).where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col) > 0).cast("int").alias("y")))
    train = Marks.by_id(docs, marks, id_col, use, entries)

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            counts.add(texts, [2 * half_of(t) + y for t, y in zip(texts, batch["y"], strict=True)])
            if counts.full():
                yield counts.frame()
                counts = WordCounts(shared.value)
        if counts.n.any():
            yield counts.frame()

    sums = [F.sum(c).alias(c) for c in _COUNTS]
    counted = scratch(spark, "toxic-words")
    schema = "word string, " + ", ".join(f"{c} long" for c in _COUNTS)
    for runs in train.passes:
        rows = train.read(runs).select(F.col(text_col).alias("text"), "y")
        rows.mapInPandas(presence, schema).groupBy("word").agg(*sums).write.mode("append").parquet(counted)
    seen = spark.read.schema(schema).parquet(counted) if train.passes else spark.createDataFrame([], schema)
    if len(train.passes) > 1:
        seen = written(seen.groupBy("word").agg(*sums), "toxic-words")
    whole = seen.where("word = ''").first()
    n = {c: whole[c] if whole else 0 for c in _COUNTS}
    n_neg, n_pos = n["neg0"] + n["neg1"], n["pos0"] + n["pos1"]

    def ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
        return F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))

    # Evidence is a word of toxic rows at least e times as frequent there, in
    # each half of the learning rows by itself.
    halves = [(F.col(f"pos{h}") >= 2) & (ratio(F.col(f"pos{h}"), F.col(f"neg{h}"), n[f"pos{h}"], n[f"neg{h}"]) > 1) for h in (0, 1)]
    pos, neg = F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1")
    views = F.when(halves[1], 1).otherwise(0) + F.when(halves[0], 2).otherwise(0) + F.when(halves[0] & halves[1], 4).otherwise(0)
    # Spark's hash is XXH64 with seed 42 over the UTF-8 bytes.
    evidence = written(seen.where(F.col("word") != "").where((pos >= min_docs) & (halves[0] | halves[1]))
                       .select(F.xxhash64("word").alias("h"), ratio(pos, neg, n_pos, n_neg).alias("w"), views.alias("views")).where("w > 1"), "toxic-evidence")
    blocks = evidence.count() // block_words + 1

    # A half's cells come from the evidence that the other half shows.
    held: Counter = Counter()
    toxic: Counter = Counter()
    for runs in train.passes:
        rows = train.read(runs).select(F.col(text_col).alias("text"), "y")
        placed = _celled(rows, restorer, evidence, blocks, by_half=True).groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
        for r in placed.collect():  # N_CELLS rows at most
            held[r["cell"]] += r["n"]
            toxic[r["cell"]] += r["pos"]
    base = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
    shares = rising([held[c] + 2.0 for c in range(N_CELLS)], [toxic[c] + 2 * base for c in range(N_CELLS)])
    return Model(restorer, evidence, blocks, tuple(shares))


def _celled(rows: DataFrame, restorer: Restorer, evidence: DataFrame, blocks: int, by_half: bool, text_col: str = "text") -> DataFrame:
    """``rows`` with ``cell``. Evidence of one block goes to the workers in one
    pass. More blocks are a written pass each, one after the other, over the row
    keys, so that no task ever holds two; the passes meet on the keys."""
    def weights(shared: Broadcast) -> Callable[[Column], Column]:
        @F.pandas_udf("array<double>")
        def of(texts: pd.Series) -> pd.Series:
            rows = [t or "" for t in texts]
            return pd.Series(shared.value.strongest(rows, [half_of(t) if by_half else OTHERS for t in rows]), dtype=object)
        return of

    def cell(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(found) == 0, 0).otherwise(F.least(F.floor(total), F.lit(N_CELLS - 2)).cast("int") + 1)

    if blocks == 1:
        return rows.withColumn("cell", cell(weights(finder(restorer, evidence))(F.col(text_col))))
    keyed = Rows(rows)
    rows, row = keyed.frame(), keyed.name
    at = scratch(rows.sparkSession, "toxic-found")
    for b in range(blocks):
        shared = finder(restorer, evidence, b, blocks)
        rows.select(row, weights(shared)(F.col(text_col)).alias("found")).where(F.size("found") > 0).write.mode("append").parquet(at)
        shared.destroy()
    found = rows.sparkSession.read.parquet(at).withColumnRenamed(row, "_at").groupBy("_at").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("_all"))
    best = F.slice("_all", F.greatest(F.lit(1), F.size("_all") - 2), F.lit(3))
    return rows.join(found.select("_at", cell(best).alias("cell")), F.col(row) == F.col("_at"), "left").withColumn("cell", F.coalesce("cell", F.lit(0))).drop(row, "_at")


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted added (replacing columns so named)."""
    python_batches(docs.sparkSession)
    shares = F.array(*map(F.lit, model.table))
    rows = docs.drop("score", "predicted")
    name = free_name(rows, "cell")
    kept = rows.withColumnRenamed("cell", name) if "cell" in rows.columns else rows
    placed = _celled(kept, model.restorer, model.evidence, model.blocks, by_half=False, text_col=text_col)
    out = placed.withColumn("score", F.get(shares, F.col("cell"))).drop("cell")
    out = out.withColumnRenamed(name, "cell") if "cell" in rows.columns else out
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
