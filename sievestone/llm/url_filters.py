"""URL filtering by longest-match path rules and by association rules.

FP-growth mines combinations of URL tokens that go with a bad label; rules with
too little confidence (in itself and beside the share of bad rows in all) or support are
pruned, as are rules that a shorter one already implies. The rules that are left are a
table and an inverted index: a rule is listed under its rarest token, and urls meet
it in a join by token.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_staged, fresh, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed rules of the query contract.
PATH_RULES = (
    PathRule("allow", "com", "/"),
    PathRule("block", "example.com", "/en/"),
    PathRule("allow", "www.example.com", "/en/"),
    PathRule("block", "net", "/es/"),
    PathRule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: the labels of the host, its registered suffix, the
    segments of the path and the names of the query; runs of digits are #."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))
    parts = F.concat(
        tagged("h:", F.split(host, "[.]")),
        tagged("d:", F.array(F.substring_index(host, ".", -2))),
        tagged("p:", F.split(F.translate(path, UPPER, LOWER), "/")),
        tagged("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    )
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.3, min_lift: float = 1.5, min_rows: int = 10, min_z: float = 2.5) -> DataFrame:
    """Association rules tokens -> bad from labelled (url, bad boolean): a table of tokens
    (array), n (labelled rows that hold them all), confidence (share of bad ones) and anchor
    (the rarest of the tokens).

    A token set counts if it holds in a share of min_support of the labelled rows and in
    min_rows of them at least. A rule stays if its confidence is min_confidence or more,
    min_lift times the share of bad rows in all, and so many (min_z) standard errors
    above that share that chance is no likely cause; and if no other rule's tokens are
    among its own. Rows with a null url or label teach nothing; without rows, or without
    bad ones, there are no rules. The rules are a written table and never on the driver."""
    spark = labelled.sparkSession
    kind = "tokens array<string>, n long, confidence double, anchor string"
    rows = labelled.filter("url is not null and bad is not null").select(
        F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    n, bad = rows.agg(F.count("*"), F.count(F.when(F.array_contains("items", BAD), 1))).first()
    support = max(min_support, min_rows / n) if n else 2.0
    if not bad or support > 1:
        return spark.createDataFrame([], kind)
    base = bad / n
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=max(min_confidence, min_lift * base) if min_lift * base < 1 else 1.0).fit(rows)
    sets = model.freqItemsets
    with_bad = F.array_contains("items", BAD)
    both = sets.filter(with_bad & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_bad"))
    alone = sets.filter(~with_bad).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    confidence = F.col("n_bad") / F.col("n")
    sure = (confidence - base) >= min_z * F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    found = both.join(alone, "tokens").filter((confidence >= min_confidence) & (confidence >= min_lift * base) & sure).select("tokens", "n", confidence.alias("confidence"))
    single = alone.filter(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("n").alias("frequency"))
    anchors = found.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min(F.struct("frequency", "token"))["token"].alias("anchor"))
    rules = stage(found.join(anchors, "tokens").select("tokens", "n", "confidence", "anchor"), "url-rules")
    implied = matching(rules, rules.select(F.col("tokens").alias("need"), "anchor")).filter(F.size("need") < F.size("tokens")).select("tokens").distinct()
    kept = stage(rules.join(implied, "tokens", "left_anti"), "url-rules")
    drop_staged(rules)
    return kept


def matching(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows (with tokens) with each rule (need, anchor) of which they have all tokens.
    index is the inverted index: a rule is listed under its anchor, so a row meets, in a
    join by token, the rules of its own tokens only."""
    met = rows.drop("anchor").withColumn("anchor", F.explode("tokens")).join(index.select("need", "anchor"), "anchor")
    return met.filter(F.forall("need", lambda t: F.array_contains("tokens", t)))


def url_filter(pages: DataFrame, labelled: DataFrame, path_rules: Sequence[PathRule] = PATH_RULES, url_col: str = "url", **mining) -> DataFrame:
    """All rows and columns of pages with host, path, rule and verdict.

    rule is the longest path rule that fits (else null); its verdict wins. Other
    urls are blocked if a mined rule matches, else allowed. A null url has empty
    host and path and is allowed. Repeated rows are judged alike; very long urls are
    read whole. Columns of pages with these names are replaced, others stay.
    """
    rules = mine_rules(labelled, **mining)
    url = F.col(f"`{url_col}`")
    # Urls of one set of tokens are judged as one: only matched sets meet the pages again.
    token_set = lambda tokens: F.md5(F.concat_ws("\u0001", F.array_sort(tokens)).cast("binary"))
    sets = pages.select(url_tokens(url).alias("tokens"))
    blocked = matching(sets.select("tokens", token_set(F.col("tokens")).alias("token_set")), rules.select(F.col("tokens").alias("need"), "anchor")).select("token_set").distinct()
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = url_host(url), url_path(url)
    for r in sorted(path_rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    at, of, judged = (fresh(name, pages.columns) for name in ("token_set", "matched_set", "path_verdict"))
    df = pages.withColumns({"host": host, "path": path, "rule": rule, at: token_set(url_tokens(url)), judged: verdict})
    df = df.join(blocked.withColumnRenamed("token_set", of), F.col(f"`{at}`") == F.col(f"`{of}`"), "left")
    mined = F.when(F.col(f"`{of}`").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumn("verdict", F.coalesce(F.col(f"`{judged}`"), mined)).drop(at, of, judged)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): each page's url with the label of the document whose number is
    the last of its path; bad is low quality or toxic. A document labelled more
    than once is bad if any of its labels says so."""
    ids = pages.select("url", F.regexp_extract(url_path(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("doc_id")).filter("doc_id is not null")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return ids.join(marks, "doc_id").select("url", "bad")
