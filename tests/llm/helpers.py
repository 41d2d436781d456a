"""Small tables with the cases that every operator has to take: nulls, empty and long texts, ties, repeated rows, and columns
whose names operators use themselves."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} the" for i in range(6000))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the farm at dawn"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm at dawn"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from the farm at dawn"),
    (3, ""),
    (4, None),
    (5, " \t\n "),
    (6, "one"),
    (7, "one two"),
    (8, LONG),
    (9, "Ünïcödé wörds ÄÖÜ 日本語 text\twith\x0btabs\x0cand\r\nlines"),
    (10, "same line\nsame line\nsame line\nother"),
    (11, "a b c a b c a b c d e f"),
    (None, "no id here"),
    (0, "The quick brown fox jumps over the lazy dog and runs away from the farm at dawn"),
]
EXTRA = "words string, fp long, hash long, score double, kept boolean, start long, spans string, id long, n_words long"


def documents(spark, rows=TEXTS):
    """doc_id and text, with columns of clashing names."""
    wide = [(d, t, "w", 1, 2, 0.5, True, 3, "s", 4, 5) for d, t in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {EXTRA}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
