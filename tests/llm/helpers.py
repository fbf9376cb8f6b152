"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"


def sentence(rng, words=12, vocabulary=None):
    vocabulary = vocabulary or [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta") for b in ("bel", "dor", "fin", "gam", "hut", "jor")]
    return " ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "."


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(8, 30)) for _ in range(rng.randint(2, 6)))
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(text), 0.5, 1))
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", "", 0, None, None), (1002, " \t\n", "en", "a", 3, None, None), (1003, "x", "en", "a", 1, None, None)]
    rows += [(1004, rows[0][1], "en", "b", 1, None, None), (1004, rows[0][1], "en", "b", 1, None, None)]  # a copy, as a repeated row
    rows += [(1005, rows[2][1] + " extra", "en", "a", 1, None, None), (1006, "long " * 30_000, "en", "a", 1, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
