"""The queries of the text operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import labelled_pages, url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
}

_WS = "[\\x20\\x09-\\x0D]+"

ORACLE: dict[str, str] = {
    "op1_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_WS}', '', 'g')) > 0) as ls from d),
g as (select *, case when len(ws) >= 8 then list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' ')) else [] end as win from w),
e as (select row_number() over () as r, doc_id, t, ws, ls, win from g),
x as (select r, unnest(win) as s, unnest(range(0, len(win))) as i from e),
y as (select r, i, count(*) over (partition by r, s) as c from x),
z as (select r, i, lag(i) over (partition by r order by i) as p from y where c > 1),
k as (select r, sum(case when p is null then 8 else least(8, i - p) end) as n from z group by r),
b as (select e.doc_id, e.t, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(t, '{_WS}', '', 'g')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(coalesce(k.n, 0) as bigint) as n_repeat_words from e left join k using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > 0.4 * n_words or word_chars < 2 * n_words or word_chars > 14 * n_words
    or n_dup_lines > 0.3 * len(string_split(t, chr(10)))
    or length(t) - length(replace(t, '!', '')) > 0.5 * n_words
    or length(t) - length(translate(t, '0123456789', '')) > 0.3 * word_chars
    or length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) > 0.4 * word_chars
    or length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 0.5 * word_chars) as kept
from f""",
}


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    out = language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")


QUERIES["op8_language_id"] = op8_language_id


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "leaked", F.size("leaks").alias("n_leaks"), F.transform("leaks", lambda x: x["item"]).alias("items"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("fewest_edits"))


QUERIES["op7_decontamination"] = op7_decontamination


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import language_model

    out = language_model(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op10_language_model"] = op10_language_model


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85, m=9)


QUERIES["op9_minhash"] = op9_minhash


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES["op5_html_extraction"] = op5_html_extraction


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import SHARPENED, quality_classifier

    out = quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), **SHARPENED)
    return out.select("doc_id", "n_features", "score", "sample_key", "kept")


QUERIES["op4_quality_classifier"] = op4_quality_classifier


#: Where the public tokenizers' files lie, and the one that the queries use.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = VOCABULARY) -> DataFrame:
    from .sentencepiece_codec import load_vocabulary, tokenize

    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), load_vocabulary(model_path), keep_text=False)
    return out.select("doc_id", "n_tokens", "decoded_same", "ids")


QUERIES["op3_sentencepiece"] = op3_sentencepiece


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES["op6_suffix_dedup"] = op6_suffix_dedup

ORACLE["op9_minhash"] = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
u as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as reach from documents union select r.node, u.b from r join u on r.reach = u.a),
m as (select node, min(reach) as comp from r group by 1)
select doc_id, cast(len(sh) as bigint) as n_shingles, comp as component_id, doc_id = comp as kept from s join m on doc_id = node"""

ORACLE["op6_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
x as (select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) as w from (select doc_id, unnest(range(0, greatest(len(h) // 2 - 99, 0))) as i, h from d)),
y as (select doc_id, i, row_number() over (partition by w order by doc_id, i) as r from x),
s as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from y where r > 1),
g as (select doc_id, i, sum(case when p is null or i > p + 100 then 1 else 0 end) over (partition by doc_id order by i) as k from s),
spans as (select doc_id, k, min(i) as lo, max(i) + 100 as hi from g group by 1, 2),
cuts as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as prev from spans),
kept as (select c.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' order by lo) as head, max(hi) as last, sum(hi - lo) as gone, count(*) as n from cuts c join d on d.doc_id = c.doc_id group by 1)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id"""
