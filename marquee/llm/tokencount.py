"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are the words between white space, each with a word mark in front.
Pieces come from a SentencePiece file in rank order; the unigram score of the
piece of rank r is the Zipf log probability -log(r + 1). The forward score of a
prefix is the best sum of scores that spells it, with the number of pieces used
(ties: fewer pieces). A batch's new pre-tokens are walked in sorted order, which
visits their trie depth first: forward scores are computed once per shared
prefix and kept on the path, and the count is stored at the terminal. A
character that no piece covers costs one piece per byte (byte fallback), at a
score below all pieces.

One pass over the documents, no shuffle: every worker keeps the terminal counts
of the words it met, in a dictionary that is emptied at ``CACHE`` entries.

Defined cases: null, empty and blank texts have no pre-tokens and no tokens;
words of any length are scored whole; repeated rows each get a row; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_batches

CACHE = 600_000
#: The mark in front of a word (U+2581).
MARK = "▁"


class TrieScorer:
    """Least-cost piece counts for sets of words, sharing prefixes."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.longest = max(map(len, costs), default=1)
        self.fallback = max(costs.values(), default=0.0) + 10.0

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens per word, words in any order."""
        out: dict[str, int] = {}
        costs, longest, fallback = self.costs, self.longest, self.fallback
        path, best, used = "", [0.0], [0]  # forward costs and piece counts along the path
        for word in sorted(set(words)):
            shared = len(os.path.commonprefix((path, word)))
            del best[shared + 1:], used[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
                low, n = best[end - 1] + fallback * n_bytes, used[end - 1] + n_bytes
                for start in range(max(0, end - longest), end):
                    c = costs.get(word[start:end])
                    if c is not None:
                        cost, k = best[start] + c, used[start] + 1
                        if cost < low or cost == low and k < n:
                            low, n = cost, k
                best.append(low)
                used.append(n)
            path = word
            out[word] = used[len(word)]
        return out


def zipf_costs(model_file: str) -> dict[str, float]:
    """Piece -> -log probability by rank, of a SentencePiece file's plain pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {sp.id_to_piece(i): math.log(r + 1) + norm for r, i in enumerate(plain)}


@lru_cache(1)
def _scorer(model_file: str) -> tuple[TrieScorer, dict[str, int]]:
    return TrieScorer(zipf_costs(model_file)), {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pretokens, n_tokens."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, known = _scorer(model_file)
        for batch in batches:
            split = [t.split() if t else [] for t in batch["text"]]
            new = set().union(*split).difference(known)
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set().union(*split)
            counted = scorer.counts([MARK + w for w in new])
            known.update((w[1:], n) for w, n in counted.items())
            yield pd.DataFrame({"id": batch["id"], "n_pretokens": [len(w) for w in split],
                                "n_tokens": [sum(map(known.__getitem__, w)) for w in split]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
