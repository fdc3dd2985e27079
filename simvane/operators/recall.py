"""Recall of search results against true neighbours, by the two rules in use for graphs and for posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("query_id", "id").join(results.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's true neighbours found; 1 for a query without any."""
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    joined = queries.select("query_id").join(sizes, "query_id", "left").join(_hits(results, truth), "query_id", "left")
    return joined.select("query_id", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("size"), F.lit(1.0)).alias("recall"))


def prefix_recall(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall) over as many first ranks as both sides have; 0 if either side is empty."""
    found, real = (df.groupBy("query_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((results, "nf"), (truth, "nt")))
    sizes = found.join(real, "query_id").select("query_id", F.least("nf", "nt").alias("size"))
    first = [df.join(sizes, "query_id").where(F.col("rank") <= F.col("size")) for df in (results, truth)]
    joined = queries.select("query_id").join(sizes, "query_id", "left").join(_hits(*first), "query_id", "left")
    return joined.select("query_id", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("size"), F.lit(0.0)).alias("recall"))


def latency_percentiles(seconds: list[float]) -> dict[str, float]:
    """Nearest-rank-below percentiles of latencies, their extremes, and queries a second."""
    if not seconds:
        return {}
    s = sorted(seconds)
    out = {f"p{p}": s[min(len(s) - 1, len(s) * p // 100)] for p in (50, 90, 95, 99)}
    return out | {"min": s[0], "max": s[-1], "qps": len(s) / sum(s) if sum(s) else float("inf")}
