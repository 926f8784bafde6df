"""Every named query of the library against its SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def names():
    from sievestone.plans import catalogue

    return sorted(catalogue.QUERIES)


def value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(float(x) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from sievestone.plans import catalogue

    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    if name not in catalogue.ORACLE:
        assert rows
        return
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows
    assert rows == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_clusters_over_all_lines(spark, tmp_path):
    import random

    from sievestone.plans import catalogue

    rng = random.Random(4)
    orders = [(o, rng.randrange(40)) for o in range(60)]
    lines = [(o, rng.randrange(100, 140), rng.choice([1.0, 50.0]), rng.choice([0.0, 0.1])) for o, _ in orders]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(f"c{dict(orders)[o]}", f"s{s}") for o, s, _, _ in lines]
    want = {x: x for e in edges for x in e}
    while changed := [(a, b) for a, b in edges if want[a] != want[b]]:
        for a, b in changed:
            want[a] = want[b] = min(want[a], want[b])
    got = catalogue.QUERIES["redundancy_clusters"](spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want) and len(set(want.values())) > 1
