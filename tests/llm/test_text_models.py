"""Language ID, the quality classifier and the language model."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import language_id as li
from sievestone.llm import language_model as lm
from sievestone.llm import quality_classifier as qc

import brute

SYLLABLES = {"aa": "ka lo mi ne ro".split(), "bb": "sch wur tem pfo gli".split(), "cc": "ção nha que zin obr".split()}


def speak(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, speak(l := rng.choice(list(SYLLABLES)), rng.randrange(3, 80), rng), l) for i in range(300)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!!", "cc"), (903, speak("aa", 50, rng), None), (904, speak("aa", 200, rng) + " " + speak("bb", 200, rng), "aa"), (905, speak("cc", 20000, rng), "cc"), (None, speak("bb", 30, rng), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def test_language_id(spoken):
    out = li.language_id(spoken).collect()
    assert len(out) == spoken.count()
    held = [r for r in out if r.held_out and r.lang and r.doc_id < 900]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].languages) == ("und", 0.0, [])
    assert set(by[904].languages) == {"aa", "bb"} and 0.3 < by[904].score < 0.7
    assert by[905].languages == ["cc"] and by[905].score > 0.95
    assert all(0 <= r.score <= 1 for r in out) and by[None].held_out is False
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (brute.fold(r.doc_id, 5) == 0)


def test_mixture_against_plain(spoken):
    """Log likelihoods of runs, EM and the choice of the set, one n-gram at a time."""
    model = li.train(spoken.filter("doc_id < 200"))
    width = len(model.langs)
    for text in ("ka lo mi", speak("aa", 40, random.Random(1)) + " " + speak("cc", 30, random.Random(2)), speak("bb", 3, random.Random(3))):
        data = np.frombuffer(text.encode(), np.uint8)
        share, chosen, _ = li.infer(model, data, np.array([0, len(data)]))
        bucket = li._buckets(data, np.array([0, len(data)]))
        runs = [[0.5 * sum(float(model.log_p[b, k]) for b in bucket[i : i + li.RUN_BYTES]) for k in range(width)] for i in range(0, len(data), li.RUN_BYTES)]
        pi = [1 / width] * width
        for _ in range(li.EM_STEPS):
            new = [0.0] * width
            for r in runs:
                e = [pi[k] * math.exp(r[k] - max(r)) for k in range(width)]
                for k in range(width):
                    new[k] += e[k] / sum(e) / len(runs)
            pi = new
        assert np.allclose(share[0], pi, atol=1e-5)
        rank = sorted(range(width), key=lambda k: -pi[k])
        fits = []
        for n in range(1, width + 1):
            part = {k: max(pi[k], 1e-12) for k in rank[:n]}
            total = sum(part.values())
            fits.append(sum(math.log(sum(x / total * math.exp(r[k] - max(r)) for k, x in part.items()) + 1e-300) + max(r) for r in runs) - 1.5 * (n - 1) * math.log(len(runs) + 1))
        n = 1 + max(range(width), key=lambda k: fits[k])
        assert set(np.flatnonzero(chosen[0])) == set(rank[:n])


def test_language_of_a_long_text_is_that_of_its_pieces(spoken, monkeypatch):
    model = li.train(spoken.filter("doc_id < 200"))
    data = np.frombuffer(speak("cc", 3000, random.Random(5)).encode(), np.uint8)
    offs = np.array([0, 1000, 1000, len(data)])
    whole = li.infer(model, data, offs)
    monkeypatch.setattr(li, "_RUNS", 7)
    for a, b in zip(whole, li.infer(model, data, offs), strict=True):
        assert np.allclose(a, b)


def test_language_id_of_many_languages(spark):
    rng = random.Random(6)
    tongues = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for k in range(6)}
    say = lambda lang, n: " ".join("".join(rng.choice(tongues[lang]) for _ in range(2)) for _ in range(n))
    model = li.train(spark.createDataFrame([(say(x, 300), x) for x in tongues], "text string, lang string"))
    texts = [(n, " ".join(say(f"l{k}", 150) for k in range(n))) for n in range(1, 7)]
    out = li.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert all(sorted(r.languages) == [f"l{k}" for k in range(r.doc_id)] for r in out)


def test_language_id_without_training(spark, spoken):
    out = li.language_id(spoken.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in out] == ["und"]
    assert li.language_id(spoken.limit(0)).count() == 0
    x = li.language_id(spoken.withColumn("score", F.lit("mine")).withColumn("k", F.lit(1)))
    assert x.columns.count("score") == 1 and x.filter("k = 1").count() == spoken.count()


def test_language_model_counts(docs, corpus):
    out = {r.doc_id: r for r in lm.language_model(docs, block_bytes=20_000, parts=3).collect()}
    n, want = brute.base_scores(corpus, lambda i: brute.fold(i, 7) != 2)
    assert len(out) == len(corpus)
    for i, (tokens, known, base) in want.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, brute.fold(i, 7) == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert {r.text for r in out.values()} == {t for _, t in corpus}


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_is_a_distribution(spark, order):
    """Over all known words and one unknown, the probabilities after a word sum to one."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(60)]
    probe = [(1000 + k, f"v3 {w}") for k, w in enumerate([*words, "unseen"])] + [(2000, "v3")]
    learn = F.col("doc_id") < 1000
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    counted, tokens, types = lm.count_ngrams(df, learn, order=order)
    model = lm.learn_weights(counted, tokens, types, df.filter(learn).count(), order=order)
    assert np.allclose(model.weights.sum(1), 1) and (model.weights >= 0).all()
    found = {}
    for row in counted.collect():
        t, count, context = lm._counts(row.rows, [a.asDict() for a in row.answers], model.texts, order)
        p = lm.probabilities(model, count, context)
        for d, i in enumerate(t.table.column("doc_id").to_pylist()):
            found[i] = p[t.first[d] + 1]
    assert math.isclose(sum(found[i] for i, _ in probe), 1.0, rel_tol=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_plain(docs, corpus, order):
    """Counts, deleted estimates and EM by hand; bins of estimates make a small difference."""
    out = {r.doc_id: r for r in lm.language_model(docs, block_bytes=20_000, order=order).collect()}
    texts = {i: [*brute.words(brute.lower(t)), None] for i, t in corpus}
    learned = [i for i, _ in corpus if brute.fold(i, 7) != 2]
    seen = [Counter() for _ in range(order)]

    def gram(w, k, n):
        return tuple(w[max(0, k - n) : k + 1]) if k - n >= 0 else ("<", *w[: k + 1])

    for i in learned:
        for k in range(len(texts[i])):
            for n in range(order):
                seen[n][gram(texts[i], k, n)] += 1
    total, types = sum(seen[0].values()), len(seen[0])

    def parts(w, k, less):
        """Estimates from the longest to the uniform, the longest context's count, and which are known."""
        p, known, context = [], [], 0
        for n in range(order - 1, 0, -1):
            c = len(learned) if k == 0 else seen[n - 1][gram(w, k - 1, n - 1)]
            context = context if n < order - 1 else c
            p.append((seen[n][gram(w, k, n)] - less) / (c - less) if c > less else 0.0)
            known.append(c > 0)
        return [*p, (seen[0][gram(w, k, 0)] - less) / (total - less), 1 / (types + 1)], context, [*known, True, True]

    bucket = lambda c: min(int(math.log2(max(c, 1))), lm.BUCKETS - 1)
    held = {}
    for i in learned:
        for k in range(len(texts[i])):
            p, c, _ = parts(texts[i], k, 1)
            held.setdefault(bucket(c), []).append(p)
    weights = {}
    for b, rows in held.items():
        w, rows = np.full(order + 1, 1 / (order + 1)), np.array(rows)
        for _ in range(100):
            r = rows * w
            w = (r / r.sum(1, keepdims=True)).mean(0)
        w[-1] = max(w[-1], 1e-6)
        weights[b] = w / w.sum()
    for i, _ in corpus:
        want = 0.0
        for k in range(len(texts[i])):
            p, c, known = parts(texts[i], k, 0)
            b = bucket(c)
            while b not in weights:
                b -= 1
            w = weights[b] * np.array(known)
            want += math.log10(float(w @ np.array(p)) / w.sum())
        assert abs(out[i].score - want) <= 0.01 * abs(want) + 0.05 * math.sqrt(len(texts[i])), i


@pytest.mark.parametrize(("fan", "parts"), [(2, 2), (2, 9), (3, 30)])
def test_levels_give_the_same_counts(docs, fan, parts):
    """Cells over one level and over several."""
    one = {r.doc_id: r for r in lm.language_model(docs, block_bytes=4000, order=3).collect()}
    many = {r.doc_id: r for r in lm.language_model(docs, block_bytes=4000, order=3, parts=parts, fan=fan).collect()}
    for i, r in one.items():
        m = many[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (m.n_tokens, m.n_known, m.train_tokens, m.base_score)
        assert math.isclose(r.score, m.score, rel_tol=1e-9)


def test_language_model_odd_tables(docs, no_docs):
    assert lm.language_model(no_docs).count() == 0
    none = lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    x = lm.language_model(docs.union(docs).withColumn("score", F.lit(0)), keep_text=False)
    assert x.count() == 2 * docs.count() and x.columns.count("score") == 1 and "text" not in x.columns


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(6)
    good = [f"good{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(1500):
        kind = "junk" if i % 5 == 0 else "toxic" if i % 5 == 1 else "clean"
        w = [rng.choice(good) for _ in range(rng.randrange(30, 60))]
        if kind == "junk":
            w = [f"junk{rng.randrange(30)}" for _ in w]
        elif kind == "toxic":
            for k in range(6):
                w[rng.randrange(len(w))] = f"rude{k}"
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 0 if kind == "junk" else 1, 1 if kind == "toxic" else 0))
    rows += [(5000, None), (5001, ""), (None, " ".join(good)), (5002, "good1 " * 9000)]
    labels += [(None, 1, 0), (7, None, 0), (10, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_keeps_clean_and_drops_bad(graded):
    docs, labels = graded
    out = qc.quality_classifier(docs, labels, **qc.SHARPENED).collect()
    assert len(out) == docs.count()
    kept = {r.doc_id: r.kept for r in out}
    share = lambda rest: np.mean([kept[i] for i in range(1500) if i % 5 in rest])
    assert share({2, 3, 4}) > 0.97 and share({0}) < 0.02 and share({1}) < 0.05


def test_importance_sample_against_plain(graded):
    """Weights and sample as a plain version counts them, word by word."""
    docs, labels = graded
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            marks.setdefault(r.doc_id, []).append(r.quality == 1 and not r.toxic)
    good = {i for i, m in marks.items() if all(m)}
    grams = []
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        grams.append(qc.features(data, np.array([0, len(data)]))[0].tolist())
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if i in good:
            target.update(g)
    scale = sum(target.values()) / sum(raw.values())
    want = [sum(math.log((target[x] + 1) / (raw[x] * scale + 1)) for x in g) for g in grams]
    got = {r.doc_id: r for r in qc.quality_classifier(docs, labels, k=700).collect()}
    for (i, _), w, g in zip(rows, want, grams, strict=True):
        assert math.isclose(got[i].score, w, rel_tol=1e-4, abs_tol=1e-3) and got[i].n_features == len(g)
    assert min(want) < -5 and max(want) > 5
    noise = {r.doc_id: r.sample_key - r.score for r in got.values()}
    u = sorted(math.exp(-math.exp(-x)) for x in noise.values())
    assert max(abs(x - (k + 0.5) / len(u)) for k, x in enumerate(u)) < 0.05  # Gumbel noise
    top = sorted(got.values(), key=lambda r: -r.sample_key)
    assert {r.doc_id for r in top[:700]} == {r.doc_id for r in got.values() if r.kept}
    clean = np.mean([got[i].kept for i in range(1500) if i % 5 > 1])
    assert clean > 0.7 > 0.2 > np.mean([got[i].kept for i in range(1500) if i % 5 < 2])


def test_classifier_odd_tables(graded):
    docs, labels = graded
    assert qc.quality_classifier(docs.limit(0), labels).count() == 0
    assert qc.quality_classifier(docs, labels.limit(0)).filter("not kept").count() == 0
    x = qc.quality_classifier(docs.withColumn("score", F.lit("a")).withColumn("e", F.lit(1)), labels)
    assert x.columns.count("score") == 1 and "e" in x.columns


def test_kth_largest(spark):
    rng = random.Random(0)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [1.5] * 500 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in (1, 2, 137, 600, 3000, 3500):
        assert qc.kth_largest(df, "v", k, bins=8, few=50) == want[k - 1]
    assert qc.kth_largest(df, "v", 3501) is None
