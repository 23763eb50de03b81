"""A small table with every awkward row: nulls, empty and very long texts, repeated rows, shared ids, clashing column names."""

import random

random.seed(5)
WORDS = ["alpha", "Beta", "gamma", "the", "of", "é", "naïve", "x1", "Ω", "delta"]
LONG = " ".join(random.choice(WORDS) + str(random.randint(0, 400)) for _ in range(20_000))
BASE = " ".join(random.choice(WORDS) + str(random.randint(0, 400)) for _ in range(120))
TAIL = BASE.replace(" ", "  ", 3) + " more words at the end"

ROWS = [
    (1, None), (2, ""), (3, "one"), (4, " \n\t "), (5, BASE), (5, BASE), (6, BASE), (7, TAIL), (None, BASE), (None, None), (8, LONG), (9, LONG[:-10]), (10, "a" * 3000), (11, "Ab" * 700 + "é" * 300),
    (12, "Das ist ein Satz. " * 40), (13, "\u0000\u0001 odd ퟿ bytes"), (14, "one"), (14, "two words"), (15, "$$$ !! ###"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, w string, first string, mark string, size string, id string, spans string, __id string, __own string, gone_id string, text_key string, digest string"


def table(spark, rows=ROWS):
    data = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", len(t or ""), "k", "w", "f", "m", "s", "i", "p", "q", "o", "g", "t", "d") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
