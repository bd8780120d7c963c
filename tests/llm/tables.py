"""Awkward rows that every operator must survive."""

import random

WORDS = [f"w{k}" for k in range(40)]


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark):
    """doc_id, text and columns whose names the operators use themselves."""
    rng = random.Random(7)
    long = words(rng, 30_000)
    rows = [(1, "a b c d e f g h i j k", "x"), (2, None, None), (3, "", "x"), (4, "   \n\t ", "x"), (5, long, "x"), (6, long, "x"), (7, "a b c d e f g h i j k", "x"), (7, "a b c d e f g h i j k", "x"), (None, "a b c d e f g h i j k", None), (8, "word", "y"), (9, "word", "y"), (10, "x" * 50_000, "y")]
    schema = "doc_id long, text string, kept string, class_id string, component_id string, score string, predicted string, n_words string, starts string, label string, labels string, bands string"
    return spark.createDataFrame([(a, b, *[c] * 10) for a, b, c in rows], schema)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
