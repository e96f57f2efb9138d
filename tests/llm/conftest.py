import os
import random
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, row string, component string"


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    """Python workers find the package beside the tests."""
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def prose(rng, words, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary):03d}x" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: copies, near copies, shared passages, ties, nulls, empty, very long and repetitive texts."""
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, rng.randrange(20, 160)).replace(" b0", "\nB0")) for k in range(40)]
    near = base.split()
    rows += [(100 + k, " ".join(near[:k] + ["Changed"] + near[k + 1:])) for k in range(0, 60, 10)]
    rows += [(200 + k, base) for k in range(5)]
    rows += [(300 + k, prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 40)) for k in range(6)]
    rows += [(400, None), (401, ""), (402, "one two three"), (403, "One  two\tTHREE"), (404, "a" * 700), (405, " ".join(["again"] * 300)),
             (406, "\n\n\n"), (407, "Änderung élan ñandú — 漢字 🙂 " * 30), (408, prose(rng, 3000)), (409, "short line\nshort line\nSHORT LINE ")]
    rows += [(410, rows[3][1]), (410, rows[3][1]), (411, prose(rng, 30)), (411, prose(rng, 30)), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "c") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
