import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

VOCABULARY = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}or" for i in range(400)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): odd texts, copies, near copies, shared passages, a long text."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    passage = say(60)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "!!! ??? ..."), (8, "äöü ß ñ É 汉字 😀 " + say(5))]
    rows += [(10 + i, say(rng.randrange(5, 120))) for i in range(20)]
    base = say(150).split()
    for i in range(12):
        w = list(base)
        for _ in range(i // 2):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((40 + i, " ".join(w)))
    rows += [(60 + i, rows[9][1]) for i in range(6)]
    rows += [(70 + i, f"{say(20)} {passage} {say(20)}") for i in range(8)]
    rows += [(80, "ab " * 3000), (81, "x" * 5000), (82, say(4000)), (83, "line one of it\n" * 40 + say(30)), (84, "é" * 300)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
