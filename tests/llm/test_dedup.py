"""Near duplicates, repeated substrings and benchmark leaks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import _induced_sort as sort
from sievestone.llm import decontamination as dc
from sievestone.llm import minhash as mh
from sievestone.llm import suffix_dedup as sd

import brute


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_against_all_pairs(docs, corpus, width, percent):
    out = {r.doc_id: r for r in mh.near_groups(docs, shingle=width, percent=percent).collect()}
    want = brute.components(corpus, width, percent)
    assert len(out) == len(corpus)
    for i, t in corpus:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(brute.shingle_set(t, width)), want[i], want[i] == i)


@pytest.mark.parametrize("percent", [60, 85])
def test_small_tiles_lose_no_link(docs, corpus, percent):
    """Tiles of three nodes: every family is taken apart and compared in pairs of tiles."""
    out = {r.doc_id: r.component_id for r in mh.near_groups(docs, shingle=3, percent=percent, m=12, half=1, tile=3).collect()}
    assert out == brute.components(corpus, 3, percent)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_sets_alike_have_a_rare_shingle_in_common(percent):
    rng = np.random.default_rng(4)
    count = rng.integers(0, 50, 1 << mh.RARITY_BITS)
    common = rng.integers(1, 2**63, 400, dtype=np.uint64)
    met = 0
    for _ in range(2000):
        shared = rng.choice(common, rng.integers(1, 60), replace=False)
        x, y = (np.unique(np.concatenate([shared, rng.integers(1, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(2))
        if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
            met += 1
            assert len(np.intersect1d(mh.rarest(x, count, percent), mh.rarest(y, count, percent)))
    assert met > 5


def test_texts_around_one_passage_fall_apart(spark):
    """They share most tables' keys, but no rare shingle, so they are not compared with each other."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    passage = say(70)
    rows = [(i, f"{passage} {say(30)}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = df.select(F.col("doc_id").alias("node"), "text").collect()
    texts = spark.createDataFrame([(r.node, bytearray(mh.pack(r.text.encode()))) for r in sets], "node long, packed binary")
    found = texts.select("node", F.lit(0).cast("long").alias("comp"))
    apart = mh.split_families(found, texts, 3, 80).groupBy("comp").agg(F.sort_array(F.collect_list("node")).alias("nodes")).collect()
    assert sorted(r.nodes for r in apart) == [[i, 200 + i] for i in range(5)]
    out = {r.doc_id: r.component_id for r in mh.near_groups(df, shingle=3, percent=80, tile=10).collect()}
    assert out == brute.components(rows, 3, 80)


def test_near_groups_odd_rows(spark, no_docs):
    assert mh.near_groups(no_docs).count() == 0
    text = "a b c d e f g h i j k l m n"
    rows = [(3, text), (3, "other words here that stand alone in this text"), (9, text), (9, text), (None, text), (4, "other words here that stand alone in this text"), (11, None)]
    out = mh.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == sorted([(3, 3, True), (3, 3, True), (9, 3, False), (9, 3, False), (-1, -1, True), (4, 3, False), (11, 11, True)])
    x = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(5)), shingle=3)
    assert x.count() == len(rows) and x.columns == ["doc_id", "text", "component_id", "kept"]


def test_components_of_a_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 120], "a long, b long").repartition(4)
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    got = {r.node: r.comp for r in mh.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 120 else 121 if i <= n else i for i in range(n + 2)}


def test_tile_links_against_plain():
    rng = random.Random(2)
    base = rng.sample(range(10**6), 60)
    sets = [np.array(sorted(set(base) - set(rng.sample(base, k % 9)) | set(rng.sample(range(10**6), k % 7)))).astype(np.uint64) for k in range(40)]
    a, b = mh.tile_links(sets, 85, 100)
    whole = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) <= whole
    assert len(a) == len(mh._forest(np.array([x for x, _ in sorted(whole)]), np.array([y for _, y in sorted(whole)]), 40))
    a, b = mh.tile_links(sets, 85, 100, 15)
    assert all(x < 15 <= y and (x, y) in whole for x, y in zip(a, b, strict=True))


def test_suffix_order_against_sorting():
    rng = random.Random(0)
    for k in range(150):
        n, letters = rng.randrange(1, 200), rng.choice([1, 2, 3, 26])
        t = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
        t = np.tile(t[: max(1, n // 5)], 5) if k % 3 == 0 else t
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sort.suffix_order(t, 10**6, limit=rng.choice([32, 1 << 20])).tolist() == want
        d = rng.randrange(1, 30)
        assert [b[i : i + d] for i in sort.suffix_order(t, d)] == [b[i : i + d] for i in want]


def test_suffix_dedup_against_plain(docs, corpus):
    out = {r.doc_id: r for r in sd.suffix_dedup(docs, block_bytes=20_000).collect()}
    for i, want in brute.removed(corpus).items():
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        if not r.n_removed:
            assert r.text == (dict(corpus)[i] or "")
    assert sum(r.n_removed > 0 for r in out.values()) > 10


@pytest.mark.parametrize(("hot", "parts", "fan"), [(0, None, 256), (1, 2, 2), (128, 9, 2), (2, 30, 3)])
def test_levels_and_second_anchors_change_nothing(docs, corpus, hot, parts, fan):
    out = {r.doc_id: r for r in sd.suffix_dedup(docs, block_bytes=6_000, keep_text=False, hot=hot, parts=parts, fan=fan).collect()}
    for i, want in brute.removed(corpus).items():
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i


def test_suffix_dedup_multibyte_and_odd_tables(spark, no_docs):
    assert sd.suffix_dedup(no_docs).count() == 0
    text = "é" * 100
    rows = [(1, "x" + text), (2, text + "y"), (None, text), (5, "short"), (5, "short"), (7, None)]
    out = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_spans", F.lit("a")).withColumn("e", F.lit(1)))
    assert out.columns == ["doc_id", "text", "e", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and out.count() == 6
    assert all(r.text is not None for r in out.collect())
    with pytest.raises(ValueError):
        sd.suffix_dedup(no_docs, length=20)


def test_rows_of_one_id_are_one_document(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.suffix_dedup(df, keep_text=False).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]


def edit(words, n, rng):
    w = list(words)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[at] = f"new{rng.randrange(99)}"
        elif k == 1:
            w.insert(at, f"new{rng.randrange(99)}")
        elif len(w) > 2:
            del w[at]
    return w


def distance(a, b):
    """Fewest word edits between a and any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_leaks_against_plain(spark, similarity):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(150)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: say(n) for i, n in enumerate((1, 3, 6, 12, 15, 25, 40, 80))}
    texts = {}
    for k in range(160):
        item = items[k % len(items)]
        body = edit(item, rng.randrange(0, max(1, int(len(item) * (1.3 - similarity)))), rng)
        texts[k] = say(rng.randrange(30)) + body + say(rng.randrange(30))
    texts[500], texts[501] = [], say(3000) + items[6] + say(3000)
    rows = [(i, " ".join(t).upper() if i % 2 else ", ".join(t)) for i, t in texts.items()] + [(900, None)]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, ""), (79, "...")]
    out = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"), similarity=similarity)
    got = {r.doc_id: {x.item: x.edits for x in r.leaks} for r in out.collect()}
    assert got[900] == {} and got[500] == {}
    wanted = found = 0
    for i, t in texts.items():
        want = {k: e for k, w in items.items() if (e := distance(w, t) if t else 99) <= int((1 - similarity) * len(w) + 1e-9)}
        assert all(got[i][k] == want.get(k) for k in got[i]), i
        wanted, found = wanted + len(want), found + len(got[i])
    assert found >= 0.99 * wanted and wanted > 100


def test_leaks_with_edits_spread_evenly(spark):
    """Every fifth word replaced: no six words in a row stay whole."""
    rng = random.Random(1)
    items = [[f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(15, 60))] for _ in range(300)]
    texts = []
    for w in items:
        n, t = int(0.2 * len(w)), list(w)
        for k in range(n):
            t[min(len(w) - 1, 4 + 5 * k)] = f"u{rng.randrange(10**6)}"
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: [(x.item, x.edits) for x in r.leaks] for r in dc.decontaminate(df, bench).collect()}
    assert sum(got[i] == [(i, distance(items[i], texts[i]))] for i in got) >= 0.99 * len(items)


def test_walks_are_tables_of_sampled_places():
    words = np.random.default_rng(1).integers(1, 2**63, 80, dtype=np.uint64)
    t = dc.Table.draw(3, 4)
    keys, which = t.keys(words, np.arange(80), np.full(80, 80))
    bits = dc.mix64(words ^ np.uint64(4 * 0x9E3779B97F4A7C15 % 2**64))
    for key, start in zip(keys, which, strict=True):
        at, path = int(start), []
        for j in range(12):
            path.append(at)
            if at < 80:
                at += int(bits[at]) >> j & 1
        h = np.array([4], np.uint64)
        for p in t.places:
            h = dc._fold(h, words[path[p] : path[p] + 1])
        assert h[0] == key
    assert len(which) > 20


def test_refused_similarity(docs):
    with pytest.raises(ValueError):
        dc.decontaminate(docs, docs, similarity=0.4)


def test_leaks_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, none).filter("leaked").count() == 0
    bench = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two")], "item_id long, text string")
    assert dc.decontaminate(no_docs, bench).count() == 0
    out = dc.decontaminate(docs.withColumn("leaked", F.lit(1)), bench)
    assert out.columns == ["doc_id", "text", "leaks", "leaked"]
    assert {r.doc_id for r in out.filter("leaked").collect()} == {5, 6}
