"""Documents with the cases that every operator must stand: nulls, empty and long texts, copies, clashing columns."""

import random


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


PASSAGE = words(100, 60)
LONG = words(200, 3000)
DOCS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, words(4, 5)),
    (5, words(5, 80)),
    (6, words(5, 80)),
    (7, words(5, 79) + " changed"),
    (8, words(8, 30) + " " + PASSAGE + " " + words(9, 30)),
    (9, words(10, 20) + " " + PASSAGE + "\n" + words(11, 40)),
    (10, LONG),
    (11, LONG[: len(LONG) // 2] + " gap " + LONG[len(LONG) // 2 :]),
    (12, "spam " * 400),
    (13, "Émile ñandú 日本語 ¿qué? ½ " + words(13, 20)),
    (14, "a"),
    (15, PASSAGE + " " + PASSAGE),
    (16, "x" * 5000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, key bigint, h bigint, at int, a bigint"


def documents(spark, rows=None, lang="en"):
    """The cases (or other rows) with columns that clash with the operators' own names."""
    rows = DOCS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, None, 0, None, 1, 2) for i, t in rows], SCHEMA).repartition(3)
