"""Small tables with all that an operator must bear, and brute-force versions."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names operators use inside; they must not matter.
CLASHING = "key string, pos int, fp long, node long, line string, h1 long, word string, n int, kept string, score string, n_words string, copies int, salt int, doc long, ranges string"
DOC = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = ("k", 1, 2, 3, "l", 4, "w", 5, "no", "s", "nw", 6, 7, 8, "r")


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]], source=lambda i: f"s{i % 3}") -> DataFrame:
    data = [(i, t, "en", source(k), None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOC).repartition(3)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i, w in enumerate(words(rng, n)):
        out.append(w.capitalize() if i % 9 == 0 else w + (rng.choice([". ", ".\n", "! "]) if i % 9 == 8 else " "))
    return " ".join(out).replace("  ", " ")


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank texts, repeated rows, one id with two texts, other scripts, a long text."""
    rng = random.Random(5)
    long = prose(rng, 20_000)
    same = prose(rng, 60)
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (None, None), (None, same), (4, same), (4, same), (5, same), (6, "x"), (7, "ü" * 50 + "\nÜ" * 3), (8, long), (9, long.replace("a", "A", 1)),
        (10, "no line end"), (11, "one\n\none\ntwo words here for all\n"), (12, "Two Words here for all \n\x0bTWO WORDS HERE FOR ALL\x0c"), (12, "another text of the same id"), (13, "a b c d"), (14, "\x00zero"),
    ]


def collect(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
