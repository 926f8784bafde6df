"""Extension points: what each step of retrieval takes and gives as DataFrames, a registry for
implementations of them, and the run that puts them together."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, lexical


@runtime_checkable
class FileScanner(Protocol):
    def scan(self, root: str) -> DataFrame:
        """(path, text) of the files under root."""


@runtime_checkable
class CodeParser(Protocol):
    def parse(self, files: DataFrame) -> DataFrame:
        """(path, name, kind, start_line, end_line) of what files define."""


@runtime_checkable
class LexicalIndex(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank)."""


@runtime_checkable
class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """texts (id, text) -> (id, vector)."""


@runtime_checkable
class StorageAdapter(Protocol):
    def read(self, name: str) -> DataFrame: ...

    def write(self, name: str, rows: DataFrame) -> None: ...


@runtime_checkable
class QueryPreparer(Protocol):
    def prepare(self, queries: DataFrame) -> DataFrame:
        """(query_id, text) -> the same, as they are to be searched."""


@runtime_checkable
class HybridMerger(Protocol):
    def merge(self, results: list[DataFrame]) -> DataFrame:
        """Rankings -> one (query_id, doc_id, score, rank)."""


@runtime_checkable
class StructuralExpander(Protocol):
    def expand(self, ranked: DataFrame) -> DataFrame:
        """More rows (query_id, doc_id, score, rank) beside those given."""


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, ranked: DataFrame, queries: DataFrame) -> DataFrame:
        """The same rows with new scores and ranks."""


@runtime_checkable
class BlockScorer(Protocol):
    def score(self, ranked: DataFrame) -> DataFrame:
        """The same rows with final and tokens."""


@runtime_checkable
class BudgetManager(Protocol):
    def pack(self, scored: DataFrame) -> DataFrame:
        """The rows that fit, with used."""


@runtime_checkable
class Stitcher(Protocol):
    def stitch(self, packed: DataFrame) -> DataFrame:
        """(query_id, context)."""


@runtime_checkable
class DiagnosticProvider(Protocol):
    def diagnose(self, packed: DataFrame) -> DataFrame:
        """(query_id, ...) measures of the context."""


POINTS: dict[str, type] = {
    "scanner": FileScanner, "parser": CodeParser, "index": LexicalIndex, "embedder": Embedder, "storage": StorageAdapter, "preparer": QueryPreparer, "merger": HybridMerger,
    "expander": StructuralExpander, "reranker": Reranker, "scorer": BlockScorer, "budget": BudgetManager, "stitcher": Stitcher, "diagnostics": DiagnosticProvider,
}


class Registry:
    """Implementations by the name of their extension point; several of one point by a name each."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Any] = {}

    def register(self, point: str, service: Any, name: str = "default") -> None:
        """Refuses an unknown point, and a service that lacks what the point asks for."""
        if point not in POINTS:
            raise KeyError(f"no extension point {point}")
        if not isinstance(service, POINTS[point]):
            raise TypeError(f"{type(service).__name__} is no {POINTS[point].__name__}")
        self._made[point, name] = service

    def get(self, point: str, name: str = "default") -> Any:
        return self._made.get((point, name))

    def all(self, point: str) -> list[Any]:
        """In the order of their names."""
        return [self._made[k] for k in sorted(self._made) if k[0] == point]


class Bm25Index:
    """A LexicalIndex over documents (doc_id, text)."""

    def __init__(self, docs: DataFrame) -> None:
        self.index = lexical.build_index(docs)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.search(self.index, lexical.query_terms(queries), k)


class ShareIndex(Bm25Index):
    """The same by term frequency over length."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.search(self.index, lexical.query_terms(queries), k, "share")


class RankFusion:
    """A HybridMerger by reciprocal ranks."""

    def __init__(self, k: int = 10) -> None:
        self.k = k

    def merge(self, results: list[DataFrame]) -> DataFrame:
        out = results[0]
        for other in results[1:]:
            out = fusion.rrf(out, other, self.k).select("query_id", "doc_id", "score", "rank")
        return out


class TokenBudget:
    """A BudgetManager that takes rows in order while they fit, and skips those that do not."""

    def __init__(self, docs: DataFrame, budget: int) -> None:
        self.tokens = docs.select("doc_id", F.col("text").alias("content"), tx.tokens_by_length(F.col("text")).cast("long").alias("tokens"))
        self.budget = budget

    def pack(self, scored: DataFrame) -> DataFrame:
        rows = scored.join(self.tokens, "doc_id")
        listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "tokens")))
        state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<doc_id:bigint,used:bigint>>").alias("kept"))

        def step(a, x):
            used = a["used"] + x["tokens"]
            kept = F.concat(a["kept"], F.array(F.struct(x["doc_id"].cast("bigint").alias("doc_id"), used.alias("used"))))
            return F.when(used <= self.budget, F.struct(used.alias("used"), kept.alias("kept"))).otherwise(a)

        kept = rows.groupBy("query_id").agg(F.explode(F.aggregate(listed, state, step)["kept"]).alias("x")).select("query_id", "x.*")
        return kept.join(rows, ["query_id", "doc_id"])


def run(registry: Registry, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query (query_id, text) through the registered steps: prepared, searched by every index,
    merged, expanded, reranked, scored, packed and stitched. Steps without a service are left out;
    an index is needed, and a merger where there are several."""
    call = lambda point, method, *a: getattr(registry.get(point), method)(*a) if registry.get(point) else a[0]
    queries = call("preparer", "prepare", queries)
    found = [i.search(queries, k) for i in registry.all("index")]
    if not found or (len(found) > 1 and not registry.get("merger")):
        raise LookupError("an index is needed, and a merger for several")
    out = registry.get("merger").merge(found) if len(found) > 1 else found[0]
    out = call("expander", "expand", out)
    out = call("reranker", "rerank", out, queries)
    for point, method in (("scorer", "score"), ("budget", "pack"), ("stitcher", "stitch")):
        out = call(point, method, out)
    return out
