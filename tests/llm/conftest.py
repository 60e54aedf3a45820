from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, fp long, key long"


@pytest.fixture(scope="session")
def make(spark):
    """documents with extra columns whose names clash with internal ones."""
    def of(rows):
        full = [(i, t, lang, "src0", len(t) if t else None, 0.5, 7, 7, 7) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)
    return of


#: Nulls, empty, blank, letterless, repeated rows, ties, very long texts.
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t\x0b", None), (4, "12 $$ !!", "en"), (5, "the cat sat on the mat", "en"),
    (5, "the cat sat on the mat", "en"), (6, "the cat  sat on\nthe mat", None), (None, "the cat sat on the mat", "en"),
    (7, "wort " * 30_000, "de"), (8, "x" * 100_000, None), (9, "der hund liegt auf der matte", "de"),
    (10, "É é ß 漢字 \U0001f600 <|endoftext|> a\x1cb don't", "fr"),
]
