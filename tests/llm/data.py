"""Small corpora for the tests of the training-data operators."""

import random

WORDS = "the of and river stone quiet morning paper window garden letter music winter bridge market silver forest engine harbor candle mirror pencil ladder valley planet summer orange button copper thread".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, sequence_id string, n_lines int, license string, label int, y int, sig string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, None, 0.5, "x", "y", 3, "z", 1, 0, "q")


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    long = prose(rng, 60_000)
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "one"), row(6, "two words"), row(6, "two words"), row(None, "no id here at all"), row(7, long), row(8, long, None), row(9, "a" * 300_000), (10, *[None] * 12), row(11, "\n\n\n"), row(12, "é" * 5 + " \U0001f600 ünï")]
    return rows


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, rows):
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)
