"""Small tables with nulls, empty and long texts, repeated rows and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, features string, row int, words string"


def documents(spark, texts: list[tuple[int | None, str | None]]):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", "y", 1, "w") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)
