"""The pipeline's stages, each against a plain version on its own input."""

import pathlib

import brute
import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not pathlib.Path("/opt/tokenizers/piece_bpe_32k.model").exists(), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def staged(spark, corpus, tmp_path_factory):
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("sf"))
    leak = " ".join(corpus[20][1].split()[:18][::-1])
    rows = [(i, t, "en", "src0", None if t is None else len(t), 7) for i, t in corpus] + [(300, f"before it {leak} behind it", "en", "src1", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "nothing of the kind stands in any text")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = [("input", spark.read.parquet(f"{folder}/documents.parquet").toPandas())]
    at = docs
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, at, folder).write.parquet(f"{folder}/{k}")
        at = spark.read.parquet(f"{folder}/{k}")
        out.append((name, at.toPandas()))
    whole = corpus_pipeline.run(spark, folder).select("doc_id", F.sha2(F.col("ids").cast("string"), 256).alias("h")).toPandas()
    return dict(out), whole


def test_stages_keep_the_columns(staged):
    tables, _ = staged
    for name in ("language_id", "near_dedup", "suffix_dedup", "decontamination"):
        assert list(tables[name].columns) == list(tables["input"].columns)


def test_language_id_drops_what_has_no_letter(staged):
    tables, _ = staged
    want = {i for i, t in zip(tables["input"].doc_id, tables["input"].text, strict=True) if any(c.isalpha() for c in t or "")}
    assert set(tables["language_id"].doc_id) == want


def test_one_document_of_each_group(staged):
    tables, _ = staged
    x = tables["language_id"]
    group = brute.components(list(zip(x.doc_id, x.text, strict=True)), 5, 80)
    assert set(tables["near_dedup"].doc_id) == set(group.values())


def test_repeats_are_cut(staged):
    tables, _ = staged
    before, after = tables["near_dedup"], tables["suffix_dedup"].set_index("doc_id")
    for i, (n, gone, _, _) in brute.removed(list(zip(before.doc_id, before.text, strict=True))).items():
        assert len(after.text[i].encode()) == n - gone or gone and len(after.text[i].encode()) <= n - gone
        assert after.n_chars[i] == len(after.text[i])


def test_leaks_go_and_others_stay(staged):
    tables, _ = staged
    gone = set(tables["suffix_dedup"].doc_id) - set(tables["decontamination"].doc_id)
    assert gone == {300}


def test_tokens_and_run(staged):
    tables, whole = staged
    assert tables["sentencepiece"].decoded_same.all()
    assert set(whole.doc_id) == set(tables["sentencepiece"].doc_id) == set(tables["decontamination"].doc_id)
