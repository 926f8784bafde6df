"""Greedy, order-dependent selection within each query's short candidate list."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget_skip(ranked: DataFrame, budget: int, reserve: int = 0, cost: str = "tokens") -> DataFrame:
    """Rows in rank order that still fit; one that doesn't is passed over, and later
    smaller ones may fit. One fold over each query's list, without Python."""
    limit = max(0, budget - reserve)
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id"), F.col(cost).cast("long").alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,doc_id:bigint,cost:bigint,used:bigint>>").alias("kept"))
    step = lambda a, r: F.when(
        a["used"] + r["cost"] <= limit,
        F.struct((a["used"] + r["cost"]).alias("used"), F.concat(a["kept"], F.array(F.struct(r["rank"].cast("int").alias("rank"), r["doc_id"].cast("bigint").alias("doc_id"), r["cost"].alias("cost"), (a["used"] + r["cost"]).alias("used")))).alias("kept")),
    ).otherwise(a)
    return listed.select("query_id", F.explode(F.aggregate("rows", start, step)["kept"]).alias("r")).select("query_id", "r.*")


def _mmr(rows: pd.DataFrame, weight: float) -> pd.DataFrame:
    rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
    vectors = list(rows["embedding"])
    has = np.array([hasattr(x, "__len__") for x in vectors])
    m = np.zeros((len(rows), max((len(x) for x, h in zip(vectors, has, strict=True) if h), default=1)))
    for i in np.flatnonzero(has):
        m[i] = vectors[i]
    norm = np.linalg.norm(m, axis=1)
    m = m / np.where(norm == 0, 1, norm)[:, None]
    sim, score = m @ m.T, rows["score"].to_numpy(float)
    left, out = list(range(1, len(rows))), [0]
    near = sim[0].copy()
    while left:
        value = [(weight * score[i] - (1 - weight) * near[i] if has[i] else score[i]) - p * 1e-10 for p, i in enumerate(left)]
        i = left.pop(int(np.argmax(value)))
        out.append(i)
        near = np.maximum(near, sim[i])
    rows = rows.iloc[out].copy()
    rows["rank"] = range(1, len(rows) + 1)
    return rows


def mmr(candidates: DataFrame, weight: float = 0.6) -> DataFrame:
    """Re-order by weight * score - (1 - weight) * the largest cosine to a row already
    taken; the first row stays, nothing is dropped, rows without a vector keep their score."""
    return candidates.groupBy("query_id").applyInPandas(lambda x: _mmr(x, weight), candidates.schema)


def _pack(rows: pd.DataFrame, budget: int, epsilon: float, guard: float, w: tuple[float, float, float]) -> pd.DataFrame:
    rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
    score = rows["score"].to_numpy(float)
    spread = score.max() - score.min()
    unit = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
    query = set(rows["query_terms"].iloc[0]) if len(rows) else set()
    terms = [set(x) & query for x in rows["terms"]]
    files, seen, used, left, picked = set(), set(), 0, list(range(len(rows))), []
    while left:
        best = None
        for i in left:
            cost = max(1, int(rows["tokens"].iloc[i]))
            if used + cost > budget:
                continue
            gain = w[0] * unit[i] + w[1] * (0.2 if rows["file"].iloc[i] in files else 1.0) + w[2] * (len(terms[i] - seen) / max(1, len(query)))
            key = (round(gain / cost, 12), gain, -i)
            if best is None or key > best[0]:
                best = (key, i, cost)
        if best is None or (best[0][0] < epsilon and max(score[i] for i in left) < guard * score.max()):
            break
        _, i, cost = best
        picked.append(i)
        left.remove(i)
        used += cost
        files.add(rows["file"].iloc[i])
        seen |= terms[i]
    return rows.iloc[sorted(picked)]


def submodular_pack(candidates: DataFrame, budget: int, epsilon: float = 1e-4, guard: float = 0.85, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Rows of the greatest utility per token (score, new file, new query terms) until
    nothing fits or the density falls below epsilon, in ranking order."""
    return candidates.groupBy("query_id").applyInPandas(lambda x: _pack(x, budget, epsilon, guard, weights), candidates.schema)


def _objective(idx: list[int], unit, terms, files, concepts, most: int) -> float:
    if not idx:
        return 0.0
    relevance = sum(unit[i] for i in idx) / most
    covered = len(set().union(*[terms[i] for i in idx]) & concepts) / max(1, len(concepts))
    overlap = [len(terms[a] & terms[b]) / max(1, min(len(terms[a]), len(terms[b]))) for k, a in enumerate(idx) for b in idx[k + 1 :]]
    redundancy = min(1.0, float(np.mean(overlap))) if overlap else 0.0
    spread = (len({files[i] for i in idx}) - 1) / (len(idx) - 1) if len(idx) > 1 else 0.0
    return relevance + 0.8 * covered - 0.5 * redundancy + 0.4 * spread


def _celf(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
    score = rows["score"].to_numpy(float)
    spread = score.max() - score.min()
    unit = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
    cost = [max(1, int(x)) for x in rows["tokens"]]
    terms, files = [set(x) for x in rows["terms"]], list(rows["file"])
    concepts = set(rows["query_terms"].iloc[0]) if len(rows) else set()
    most = max(1, min(len(rows), budget // max(1, int(np.median(cost)))))
    value = lambda idx: _objective(idx, unit, terms, files, concepts, most)
    heap = [(-value([i]), i, 0) for i in range(len(rows))]
    heapq.heapify(heap)
    picked, now, used = [], 0.0, 0
    while heap:
        gain, i, at = heapq.heappop(heap)
        if used + cost[i] > budget:
            continue
        if at != len(picked):
            heapq.heappush(heap, (-(value([*picked, i]) - now), i, len(picked)))
            continue
        if -gain <= 0:
            break
        picked.append(i)
        now, used = value(picked), used + cost[i]
    if not picked:
        fit = [i for i in range(len(rows)) if cost[i] <= budget]
        picked = [max(fit, key=lambda i: (unit[i], -i))] if fit else []
    return rows.iloc[sorted(picked)]


def set_optimize(candidates: DataFrame, budget: int) -> DataFrame:
    """Lazy greedy choice under a token budget of the set with the best relevance,
    coverage of the query's terms, spread over files and lack of redundancy."""
    return candidates.groupBy("query_id").applyInPandas(lambda x: _celf(x, budget), candidates.schema)


def _allocate(rows: pd.DataFrame, budget: int, pressure: float) -> pd.DataFrame:
    rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
    share = min(0.5, max(0.2, 0.5 - 0.3 * pressure))
    left, out = budget, []
    for i, r in rows.iterrows():
        ratio = 0.0
        for k in range(i):
            o = rows.iloc[k]
            shared = min(o["hi"], r["hi"]) - max(o["lo"], r["lo"]) + 1
            if o["file"] == r["file"] and shared > 0:
                ratio = max(ratio, shared / max(1, min(o["hi"] - o["lo"] + 1, r["hi"] - r["lo"] + 1)))
        cap = budget if len(rows) == 1 else int(share * budget / (1 + 0.5 * pressure * ratio))
        give = max(0, min(int(r["tokens"]), left, cap))
        out.append(give)
        left -= give
    rows["allocated"] = np.array(out, np.int64)
    return rows


def budget_allocate(blocks: DataFrame, budget: int, pressure: float = 0.0) -> DataFrame:
    """allocated: tokens for each block in rank order, capped at a share of the budget
    that falls with pressure and with the overlap to earlier blocks of the file."""
    kept = [f for f in blocks.schema.fields if f.name != "allocated"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", allocated bigint"
    return blocks.select(*[f.name for f in kept]).groupBy("query_id").applyInPandas(lambda x: _allocate(x, budget, pressure), schema)
