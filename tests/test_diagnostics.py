"""Rule engines, answer scores, JSON recovery and diffs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import answers
from sievestone.functions.repair import diff, patch, recover_json
from sievestone.operators import diagnostics as dg

CODE = "import os\n\ndef f(x):\n    if x:\n        return 1\n    y = x + 1\n    y += 2\n"
LOGS = "logger.info('a')\nlogger.info('b')\nimport os\nfrom x import y\n"


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([(1, CODE), (2, LOGS), (3, ""), (4, None), (5, "a long line that repeats itself\n" * 5)], "block_id int, text string")


def test_measures_and_winner(blocks):
    m = dg.signal_noise(dg.composition(blocks, "block_id"))
    rows = {r.block_id: r for r in m.collect()}
    assert rows[1].n_lines == 6 and rows[1].definitions == 1 and round(rows[1].imports_pct, 3) == round(100 / 6, 3)
    assert rows[2].noise == 1.0 and rows[2].signal == 0.0
    assert (rows[3].signal, rows[3].noise, rows[4].n_lines) == (0.5, 0.5, 0)
    w = {r.block_id: (r.action, r.rule) for r in dg.winners(dg.propose(m, "block_id"), "block_id").collect()}
    assert w[1] == ("PROTECT", "role_define_protect") and w[2] == ("COMPACT", "logging_compact") and w[5][0] == "DEDUPE"
    assert {r.block_id: r.role for r in dg.roles(m, "block_id").collect()}[1] == "DEFINE"


def test_apply_guards_against_removing_nearly_all(spark, blocks):
    some = spark.createDataFrame([(2, "DROP"), (5, "DEDUPE"), (1, "KEEP")], "block_id int, action string")
    assert {r.block_id for r in dg.apply_actions(blocks, some, "block_id").collect()} == {1, 3, 4}
    most = spark.createDataFrame([(i, "DROP") for i in (1, 2, 3, 4, 5)], "block_id int, action string")
    assert dg.apply_actions(blocks, most, "block_id").count() == 5


def test_sufficiency_and_headings(spark):
    c = spark.createDataFrame([(1, 0, 0), (2, 3, 1), (3, 9, 9)], "q int, n int, b int")
    got = {r.q: (r.sufficient, r.score, r.missing) for r in dg.sufficiency(c, "q", "n", "b", 4, 2).collect()}
    assert got == {1: (False, 0.0, "empty_evidence,insufficient_candidates,insufficient_context_blocks"), 2: (False, 0.625, "insufficient_candidates,insufficient_context_blocks"), 3: (True, 1.0, "")}
    t = spark.createDataFrame([(1, "# A\ntext\n## a\n# B")], "k int, text string")
    assert [(r.heading, r.n) for r in dg.repeated_headings(t, "k").collect()] == [("a", 2)]


@pytest.mark.parametrize(("text", "kind", "want"), [("first a then b next c", "trace", 0.7), ("nothing", "trace", 0.1), ("nothing", "other", 1.0), ("1. a\n2. b\n3. c\n4. d\n5. e", "trace", 1.0)])
def test_steps(spark, text, kind, want):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(answers.step_score(F.col("t"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize("text", ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": 1,} done', '{"a": 1, "b": "x\ny\\d"}', 'x {"a": {"b": "}"}} y'])
def test_recover_json(text):
    assert isinstance(json.loads(recover_json(text)), dict)


@pytest.mark.parametrize("text", [None, "", "no object", "[1, 2]", "{broken"])
def test_recover_nothing(text):
    assert recover_json(text) is None


def test_diff_round_trip():
    rng = random.Random(1)
    for _ in range(100):
        a = [f"line {rng.randrange(8)}\n" for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), f"new {rng.randrange(99)}\n")
            del b[rng.randrange(len(b))]
        a, b = "".join(a), "".join(b)
        assert patch(a, diff(a, b)) == b
    assert patch("a\nb\n", "@@ -1,1 +1,1 @@\n-zz\n+y\n") is None
    moved = "new top\n" * 5 + "a\nb\nc\n"
    assert patch(moved, diff("a\nb\nc\n", "a\nX\nc\n")) == "new top\n" * 5 + "a\nX\nc\n"
