"""Text queries: profiles, estimates, classifiers, claims, chunks and block measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import text as tx
from ..operators import intervals, lexical, metrics, runs
from ._base import TOKENS, bench_queries, doc_columns, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)
ASK = "(select item_id as id, 'bench' as src, text from benchmark union all select conv_id * 1000 + turn, 'conv', text from conversations where role = 'user')"


def _asked(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("src"), "text")
    c = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("conv").alias("src"), "text")
    return b.union(c)


@query("corpus_scope_profile", "select lang, count(*) as n, min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 6) as mean, round(median(n_chars), 6) as median from documents group by rollup (lang)")
def corpus_scope_profile(spark, d):
    return metrics.size_profile(table(spark, d, "documents"), "lang", "n_chars").select("lang", "n", "least", "most", R6("mean"), R6("median"))


@query("content_hash_cdc", """with o as (select doc_id, sha256(text) as h from documents where doc_id % 11 <> 0), n as (select doc_id, sha256(case when doc_id % 7 = 0 then text || '.' else text end) as h from documents where doc_id % 13 <> 0)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.h is null then 'new' when n.h is null then 'deleted' when o.h <> n.h then 'changed' else 'unchanged' end as change from o full join n on o.doc_id = n.doc_id""")
def content_hash_cdc(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return runs.snapshot_diff(old, new, "doc_id", "h")


@query("scope_hash", "select sha256(string_agg(source || ':' || h || ':' || n || chr(10), '' order by source)) as scope_hash from (select source, count(*) as n, cast(sum(('0x' || substr(sha256(coalesce(text, '')), 1, 8))::bigint) as bigint) as h from documents group by 1)")
def scope_hash(spark, d):
    """Digest of the corpus by file and content. A file's digest is the sum of its rows' hashes,
    so it does not depend on their order and is added up before any shuffle; files are few."""
    row = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8), 16, 10).cast("bigint")
    by = table(spark, d, "documents").groupBy("source").agg(F.sum(row).alias("h"), F.count("*").alias("n"))
    line = F.struct("source", F.concat_ws(":", "source", F.col("h").cast("string"), F.col("n").cast("string")).alias("line"))
    return by.agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), F.lit("\n")), 256).alias("scope_hash"))


@query("file_and_chunk_ids", "select doc_id, substr(sha256(source || ':' || sha256(text)), 1, 16) as file_id, substr(sha256(source || ':fine:' || cast(doc_id as varchar)), 1, 24) as chunk_id, sha256(replace(text, chr(13) || chr(10), chr(10))) as text_hash from documents")
def file_and_chunk_ids(spark, d):
    c = F.col
    return table(spark, d, "documents").select("doc_id", tx.file_id(c("source"), F.sha2("text", 256)).alias("file_id"), tx.chunk_id(c("source"), F.lit("fine"), c("doc_id")).alias("chunk_id"), tx.hash_text(c("text")).alias("text_hash"))


@query("token_estimates", """select doc_id, case when length(text) = 0 then 0 else cast(greatest(1, floor(length(text) / 3.5)) as bigint) end as by_length, cast(floor(length(text) / 4) as bigint) as quarter, cast(greatest(1, floor(length(text) / 4)) as bigint) as quarter_min1, case when length(text) = 0 then 50 else cast(greatest(1, floor(length(text) / 4)) as bigint) end as quarter_or_50 from documents""")
def token_estimates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.tokens_by_length(t).alias("by_length"), tx.tokens_quarter(t).alias("quarter"), tx.tokens_quarter_min1(t).alias("quarter_min1"), tx.tokens_quarter_or(t).alias("quarter_or_50"))


_STOP = "['the','is','at','which','on','a','an','and','or','but','in','with','to','for']"


@query("prepared_terms", f"select id, src, array_to_string(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 3 and not list_contains({_STOP}, t)), ' ') as terms from {ASK}")
def prepared_terms(spark, d):
    stop = F.array(*map(F.lit, tx.STOPWORDS))
    kept = F.filter(tx.tokens(F.col("text")), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    return _asked(spark, d).select("id", "src", F.array_join(kept, " ").alias("terms"))


def _rules_sql(rules, default: str) -> str:
    cases = " ".join(f"when regexp_matches(lower(text), '{'|'.join(f'(?:{p})' for p in ps)}') then '{name}'" for name, ps in rules)
    return f"case {cases} else '{default}' end"


@query("query_intent", f"select id, src, {_rules_sql(cl.INTENT_RULES, 'unknown')} as intent from {ASK}")
def query_intent(spark, d):
    return _asked(spark, d).select("id", "src", cl.retrieval_intent(F.col("text")).alias("intent"))


@query("query_type", f"select id, src, {_rules_sql(cl.QUERY_TYPE_RULES, 'explanation')} as query_type from {ASK}")
def query_type(spark, d):
    return _asked(spark, d).select("id", "src", cl.query_type(F.col("text")).alias("query_type"))


@query("sufficiency_intent", f"select id, src, intent, case intent when 'ARCHITECTURAL' then 'STRUCTURAL,SEMANTIC' when 'BEHAVIORAL' then 'RULE,SEMANTIC' else 'RULE,STRUCTURAL,SEMANTIC' end as axes from (select id, src, {_rules_sql(cl.SUFFICIENCY_RULES, 'UNKNOWN')} as intent from {ASK})")
def sufficiency_intent(spark, d):
    x = _asked(spark, d).select("id", "src", cl.sufficiency_intent(F.col("text")).alias("intent"))
    return x.withColumn("axes", F.array_join(cl.mandatory_axes(F.col("intent")), ","))


@query("depth_intent", f"select id, src, {_rules_sql(cl.DEPTH_RULES, 'FACTUAL')} as depth, case {_rules_sql(cl.DEPTH_RULES, 'FACTUAL')} when 'ILLUSTRATIVE' then 'EXAMPLE_RECOMMENDED' when 'FACTUAL' then 'SHALLOW_OK' else 'DETAILED_REQUIRED' end as label from {ASK}")
def depth_intent(spark, d):
    x = _asked(spark, d).select("id", "src", cl.depth_intent(F.col("text")).alias("depth"))
    return x.withColumn("label", cl.depth_label(F.col("depth")))


def _count_sql(patterns) -> str:
    return " + ".join(f"case when regexp_matches(lower(text), '{p}') then 1 else 0 end" for p in patterns)


@query("required_k", f"""with x as (select id, src, len(list_distinct(list_transform(regexp_extract_all(text, '({cl.NAMED_COMPONENT})', 1), lambda t: lower(t)))) as named, {_count_sql(cl.HIGH_COMPLEXITY)} as high, {_count_sql(cl.MEDIUM_COMPLEXITY)} as medium from {ASK})
select id, src, cast(case when named >= 3 or high >= 2 or (high >= 1 and medium >= 1) then 80 when high >= 1 or medium >= 2 or named >= 2 then 65 else 50 end as bigint) as required_k from x""")
def required_k(spark, d):
    return _asked(spark, d).select("id", "src", cl.required_k(F.col("text")).alias("required_k"))


_MARK = " or ".join(f"contains(q, '{m}')" for m in cl.COMPLEX_MARKERS)


@query("routing", f"""with x as (select id, src, {_rules_sql(cl.INTENT_RULES, 'unknown')} as intent, ' ' || lower(trim(text)) || ' ' as q from {ASK}),
y as (select *, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda t: t <> '')) >= 18 or {_MARK} as complex from x)
select id, src, intent, complex, case when intent in ('implement', 'refactor', 'debug') or (intent = 'explain' and complex) then 'read_only_agentic' else 'single_pass' end as mode from y""")
def routing(spark, d):
    x = _asked(spark, d).select("id", "src", cl.retrieval_intent(F.col("text")).alias("intent"), cl.looks_complex(F.col("text")).alias("complex"))
    return x.withColumn("mode", cl.route(F.col("intent"), F.col("complex")))


@query("query_expansion", f"""with syn as (select * from (values ('the', 'that'), ('the', 'this'), ('and', 'plus'), ('with', 'using'), ('with', 'by')) s(term, extra)),
b as (select item_id as id, list_distinct({TOKENS.format('text')}[1:12])[1:0] as z, {TOKENS.format('text')}[1:12] as t from benchmark),
p as (select id, term, min(pos) as pos from (select id, unnest(t) as term, unnest(range(1, len(t) + 1)) as pos from b) group by 1, 2),
e as (select id, extra as term, min(100 + pos * 10) as pos from p join syn using (term) group by 1, 2),
u as (select id, term, min(pos) as pos from (select * from p union all select * from e) group by 1, 2)
select id, array_to_string(list(term order by pos, term), ' ') as terms from (select *, row_number() over (partition by id order by pos, term) as r from u) where r <= 20 group by id""")
def query_expansion(spark, d):
    """The first 12 tokens, each once, then synonyms of each in its order, 20 at most."""
    syn = spark.createDataFrame([("the", "that"), ("the", "this"), ("and", "plus"), ("with", "using"), ("with", "by")], "term string, extra string")
    first = F.slice(tx.tokens(F.col("text")), 1, 12)
    p = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(first).alias("p", "term")).groupBy("id", "term").agg((F.min("p") + 1).alias("pos"))
    e = p.join(syn, "term").groupBy("id", F.col("extra").alias("term")).agg(F.min(F.col("pos") * 10 + 100).alias("pos"))
    u = p.union(e.select("id", "term", "pos")).groupBy("id", "term").agg(F.min("pos").alias("pos"))
    return u.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t")).select("id", F.array_join(F.transform(F.slice("t", 1, 20), lambda x: x["term"]), " ").alias("terms"))


def _stem_sql(t: str) -> str:
    return f"""case when {t} like '%ies' and length({t}) > 4 then substr({t}, 1, length({t}) - 3) || 'y' when {t} like '%ing' and length({t}) > 5 then substr({t}, 1, length({t}) - 3)
when {t} like '%ed' and length({t}) > 4 then substr({t}, 1, length({t}) - 2) when {t} like '%es' and length({t}) > 4 then substr({t}, 1, length({t}) - 2) when {t} like '%s' and length({t}) > 3 then substr({t}, 1, length({t}) - 1) else {t} end"""


@query("stemmed_terms", f"select term, stem, count(*) as n from (select term, {_stem_sql('term')} as stem from (select unnest({TOKENS.format('text')}) as term from benchmark)) group by 1, 2")
def stemmed_terms(spark, d):
    each = table(spark, d, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    return each.groupBy("term", tx.stem(F.col("term")).alias("stem")).agg(F.count("*").alias("n"))


_CLAIMS = f"""claims as (select item_id as query_id, pos, trim(c) as claim from (select item_id, unnest(c) as c, unnest(range(1, len(c) + 1)) as pos from (select item_id, list_filter(regexp_split_to_array(text, '[.,;]|\\n'), lambda t: trim(t) <> '') as c from benchmark)) where pos <= 8)"""


@query("claim_extract", f"with {_CLAIMS} select query_id, pos, claim, len(list_distinct({TOKENS.format('claim')})) as n_terms from claims")
def claim_extract(spark, d):
    return _claims(spark, d).select("query_id", "pos", "claim", F.size(F.array_distinct(tx.tokens(F.col("claim")))).alias("n_terms"))


def _claims(spark, d):
    parts = F.slice(F.filter(F.split("text", "[.,;]|\n"), lambda t: F.trim(t) != ""), 1, 8)
    x = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(parts).alias("pos", "c"))
    return x.select("query_id", (F.col("pos") + 1).alias("pos"), F.trim("c").alias("claim"))


@query("claim_coverage", f"""with {_CLAIMS}, t as (select query_id, pos, list_distinct({TOKENS.format('claim')}) as ct from claims),
m as (select query_id, pos, doc_id, len(list_intersect(ct, dt)) / len(ct) as lex from t, (select doc_id, list_distinct({TOKENS.format('text')}) as dt from documents) where len(ct) > 0),
b as (select query_id, pos, max(lex) as lex from m group by 1, 2)
select query_id, count(*) as n_claims, sum(case when lex >= 0.75 then 1 else 0 end)::bigint as covered, round(avg(case when lex >= 0.75 then 1.0 else 0.0 end), 6) as coverage from b group by 1""")
def claim_coverage(spark, d):
    """Claims with a document that holds three quarters of their terms: of each claim the document with most."""
    ct = _claims(spark, d).select("query_id", "pos", F.array_distinct(tx.tokens(F.col("claim"))).alias("ct")).filter(F.size("ct") > 0)
    one = F.concat_ws(":", "query_id", "pos")
    terms = ct.select(one.alias("query_id"), F.explode("ct").alias("term"))
    most = lexical.rankings(table(spark, d, "documents"), {"claims": lexical.Asked(terms, "held")}, 1).select(F.col("query_id").alias("one"), "score")
    best = ct.select("query_id", "pos", F.size("ct").alias("n"), one.alias("one")).join(most, "one").select("query_id", "pos", (F.col("score") / F.col("n")).alias("lex"))
    hit = F.coalesce(F.col("lex"), F.lit(0.0)) >= 0.75
    return ct.select("query_id", "pos").join(best, ["query_id", "pos"], "left").groupBy("query_id").agg(F.count("*").alias("n_claims"), F.sum(hit.cast("long")).alias("covered"), F.round(F.avg(hit.cast("double")), 6).alias("coverage"))


_LINES = "(select doc_id, unnest(l) as line_text, unnest(range(1, len(l) + 1)) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "line_text")).select("doc_id", "source", (F.col("p") + 1).alias("line"), "line_text")


@query("line_windows", f"select doc_id, cast(floor((line - 1) / 20) as bigint) as window, min(line) as lo, max(line) as hi, count(*) as n_lines from {_LINES} group by 1, 2")
def line_windows(spark, d):
    return intervals.line_windows(_lines(spark, d), ["doc_id"], 20)


@query("chunk_sections", f"""with l as (select *, line - lag(line) over (partition by doc_id order by line) as gap from {_LINES} where length(trim(line_text)) > 200),
i as (select *, sum(case when gap is null or gap > 3 then 1 else 0 end) over (partition by doc_id order by line) as section from l)
select doc_id, cast(section as bigint) as section, min(line) as lo, max(line) as hi, count(*) as n from i group by 1, 2""")
def chunk_sections(spark, d):
    from pyspark.sql import Window as W

    long = _lines(spark, d).filter(F.length(F.trim("line_text")) > 200)
    gap = F.col("line") - F.lag("line").over(W.partitionBy("doc_id").orderBy("line"))
    x = intervals.islands(long.withColumn("gap", gap), ["doc_id"], ["line"], F.col("gap").isNull() | (F.col("gap") > 3), "section")
    return x.groupBy("doc_id", "section").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count("*").alias("n"))


@query("block_composition", f"""select doc_id, count(*) as n_lines, sum(case when trim(line_text) = '' then 1 else 0 end)::bigint as blank, sum(case when regexp_matches(line_text, '^[ ]*([-*+]|[0-9]+[.)])[ ]+') then 1 else 0 end)::bigint as items, sum(case when contains(line_text, '|') then 1 else 0 end)::bigint as table_lines, max(length(line_text)) as longest from {_LINES} group by 1""")
def block_composition(spark, d):
    t = F.col("line_text")
    one = lambda c: F.sum(c.cast("long"))
    return _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), one(F.trim(t) == "").alias("blank"), one(t.rlike("^[ ]*([-*+]|[0-9]+[.)])[ ]+")).alias("items"), one(t.contains("|")).alias("table_lines"), F.max(F.length(t)).alias("longest"))


@query("identifier_density", f"""with t as (select doc_id, {TOKENS.format('text')} as t from documents) select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, round(case when len(t) = 0 then 0 else len(list_distinct(t)) / len(t) end, 6) as density from t""")
def identifier_density(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    n, m = F.size("t"), F.size(F.array_distinct("t"))
    return t.select("doc_id", n.alias("n_tokens"), m.alias("n_distinct"), F.round(F.when(n == 0, 0.0).otherwise(m / n), 6).alias("density"))


@query("duplicate_lines", f"""select doc_id, (sum(c) - count(*))::bigint as n_duplicate from (select doc_id, line_text, count(*) as c from {_LINES} where length(trim(line_text)) > 20 group by 1, 2) group by 1""")
def duplicate_lines(spark, d):
    c = _lines(spark, d).filter(F.length(F.trim("line_text")) > 20).groupBy("doc_id", "line_text").agg(F.count("*").alias("c"))
    return c.groupBy("doc_id").agg((F.sum("c") - F.count("*")).alias("n_duplicate"))


@query("answer_structure", """with a as (select conv_id, turn, text, string_split(text, chr(10)) as l from conversations where role = 'assistant')
select conv_id, turn, len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}[ ]+[^ ]'))) + len(list_filter(l, lambda x: regexp_matches(x, '^(={3,}|-{3,})[ ]*$'))) as headings,
round(case when len(list_filter(l, lambda x: trim(x) <> '')) = 0 then 0 else len(list_filter(l, lambda x: regexp_matches(x, '^[ ]*([-*+]|[0-9]+[.)])[ ]+') and trim(x) <> '')) / len(list_filter(l, lambda x: trim(x) <> '')) end, 6) as list_density,
case when contains(text, '```') or regexp_matches(text, '(^|\\n)    [^ ]') then 1.0 else 0.0 end as code from a""")
def answer_structure(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", tx.heading_count(t).alias("headings"), F.round(tx.list_density(t), 6).alias("list_density"), tx.has_code_block(t).alias("code"))


@query("url_path_parts", r"""select page_id, regexp_replace(replace(url, '\', '/'), '^[./]+', '') as normalized, lower(list_last(regexp_split_to_array(url, '::|:|\.'))) as tail from pages""".replace("list_last(regexp_split_to_array(url, '::|:|\\.'))", "(regexp_split_to_array(url, '::|:|\\.'))[-1]"))
def url_path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", tx.normalize_path(F.col("url")).alias("normalized"), tx.identifier_tail(F.col("url")).alias("tail"))


@query("text_windows_overlap", """with p as (select doc_id, text, unnest(range(0, cast(greatest(1, ceil((length(text) - 50) / 462.0)) as bigint))) as i from documents)
select doc_id, i, length(substr(text, i * 462 + 1, 512)) as size, sha256(substr(text, i * 462 + 1, 512)) as digest from p""")
def text_windows_overlap(spark, d):
    """Windows of 512 characters that share 50 with the next."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 50) / F.lit(462.0))).cast("int")
    x = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    part = F.substring(F.col("text"), F.col("i") * 462 + 1, F.lit(512))
    return x.select("doc_id", "i", F.length(part).alias("size"), F.sha2(part, 256).alias("digest"))


@query("file_entropy_by_source", "with c as (select source, lang, count(*) as c from documents group by 1, 2), t as (select *, sum(c) over (partition by source) as t from c) select source, sum(c)::bigint as n, count(*) as distinct_langs, round(case when count(*) < 2 then 0 else sum(-(c / t) * ln(c / t)) / ln(count(*)) end, 6) as entropy from t group by 1")
def file_entropy_by_source(spark, d):
    x = metrics.group_entropy(doc_columns(spark, d).withColumnRenamed("file", "source"), ["source"], "lang")
    return x.select("source", "n", F.col("distinct").alias("distinct_langs"), R6("entropy"))


@query("bench_query_lengths", f"select item_id as query_id, len({TOKENS.format('text')}) as n_tokens, len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end as n_lines from benchmark")
def bench_query_lengths(spark, d):
    return bench_queries(spark, d).select("query_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"), tx.line_count(F.col("text")).alias("n_lines"))
