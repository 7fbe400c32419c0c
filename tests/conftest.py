import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sketchloom.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": shared}
    session = get_spark("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return random.Random(7)


def sets(spark, mapping):
    """``{name: sequence or list of sequences}`` as ``(name, seq)``."""
    rows = [(n, s) for n, some in mapping.items() for s in ([some] if isinstance(some, str) else some)]
    return spark.createDataFrame(rows, "name string, seq string")


def entries_of(spark, mapping):
    """``{name: hashes or {hash: count}}`` as sketch entries."""
    rows = []
    for name, hashes in mapping.items():
        counts = hashes if isinstance(hashes, dict) else {h: 1 for h in hashes}
        rows += [(name, slot, h, counts[h], f"k{h}") for slot, h in enumerate(sorted(counts))]
    return spark.createDataFrame(rows, "name string, slot int, h bigint, cnt bigint, kmer string")


def grams(text, k):
    return [text[i : i + k] for i in range(len(text) - k + 1)]


def flip(kmer):
    return kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(rng, length):
    return "".join(rng.choice("ACGT") for _ in range(length))
