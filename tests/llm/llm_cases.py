"""Small documents with every awkward case, shared by the tests of the training-data operators."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, quality int, g double, label string, size int"

SYLLABLES = ["ta", "ren", "ou", "li", "mé", "gor", "ße", "an", "ti", "wo", "ñe", "sul"]


def prose(rng, words):
    text = []
    for _ in range(words):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        text.append(word.capitalize() if rng.random() < 0.1 else word)
        text.append("\n" if rng.random() < 0.05 else " ")
    return "".join(text).strip()


def texts(rng, many=40):
    """Prose, near and exact copies, repeats, empty and blank texts, one long text."""
    base = [prose(rng, rng.randint(1, 160)) for _ in range(many)]
    words = base[0].split(" ")
    near = [" ".join("x" + str(k) if i == k else w for i, w in enumerate(words)) for k in range(0, len(words), 7)]
    odd = [None, "", " \n\t ", "one two", " ", "!!! ??? ...", "a" * 700, "ab " * 300, "é" * 260, prose(rng, 6000), "x\x00y\x1fz \x0b q"]
    return base + near + [base[1], base[1], base[2] + " " + base[3], base[3]] + odd


def documents(spark, rng, many=40, partitions=3):
    rows = []
    for k, text in enumerate(texts(rng, many)):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])
        rows.append((k, text, lang, source, len(text or ""), "own", 3, 0.5, "l", 9))
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rng():
    return random.Random(11)
