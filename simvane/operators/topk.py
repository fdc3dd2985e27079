"""Top-k of scored rows: within groups, across shard lists, and inside a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simvane.functions.metrics import Metric, badness, parse


def best_first(metric: str | Metric, score: str = "score") -> list[Column]:
    """Sort keys that put the best score first and NaN last, whichever way the metric points."""
    value = F.col(score)
    return [F.isnan(value).asc(), value.desc() if parse(metric).higher_is_better else value.asc()]


def top_k(scored: DataFrame, k: int, metric: str | Metric, by: tuple[str, ...] = ("query_id",), ties: tuple[str, ...] = ("id",), score: str = "score") -> DataFrame:
    """The k best rows of each group with their ``rank`` from 1; equal scores go by ``ties``. k = 0 gives no rows.

    Spark limits each task's groups to k rows before it shuffles them.
    """
    order = Window.partitionBy(*by).orderBy(*best_first(metric, score), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_local_results(lists: list[DataFrame], k: int, metric: str | Metric, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The global top-k of shard-local results (query_id, id, score, ...), as one union and one top-k."""
    merged = lists[0].drop("rank")
    for other in lists[1:]:
        merged = merged.unionByName(other.drop("rank"))
    return top_k(merged, k, metric, ties=ties)


def best_columns(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row of ``keys`` the places of the k least, ties by the smaller id; unordered."""
    n, width = keys.shape
    if width <= k:
        return np.broadcast_to(np.arange(width), (n, width))
    at = np.argpartition(keys, k - 1, axis=1)[:, :k]
    chosen = np.take_along_axis(keys, at, 1)
    border = chosen.max(1, keepdims=True)
    tied = np.flatnonzero((keys == border).sum(1) > (chosen == border).sum(1))
    if len(tied):
        at[tied] = np.lexsort((ids[tied], keys[tied]), axis=1)[:, :k]
    return at


class BlockTopK:
    """The best k of each query of a block so far, ties by the smaller id; what it holds grows with queries and k alone."""

    def __init__(self, queries: int, k: int, metric: str | Metric):
        self.k, self.metric = k, parse(metric)
        self.scores, self.ids = np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)

    def add(self, score: Callable[[slice, slice], np.ndarray], ids: np.ndarray, tile: int = 1 << 21) -> None:
        """Scores all queries with rows ``ids`` by ``score(queries, rows)``, in tiles of at most ``tile`` scores."""
        queries, rows = len(self.scores), min(len(ids), 8192)
        step = max(1, tile // max(1, rows))
        scores, found = [], []
        for lo in range(0, queries, step):
            mine = slice(lo, min(queries, lo + step))
            held_scores, held_ids = self.scores[mine], self.ids[mine]
            for at in range(0, len(ids), rows or 1):
                part = slice(at, min(len(ids), at + rows))
                new = score(mine, part)
                new_ids = np.broadcast_to(ids[part], new.shape)
                best = best_columns(badness(self.metric, new), new_ids, self.k)
                held_scores = np.concatenate([held_scores, np.take_along_axis(new, best, 1)], 1)
                held_ids = np.concatenate([held_ids, np.take_along_axis(new_ids, best, 1)], 1)
                best = best_columns(badness(self.metric, held_scores), held_ids, self.k)
                held_scores, held_ids = np.take_along_axis(held_scores, best, 1), np.take_along_axis(held_ids, best, 1)
            scores.append(held_scores)
            found.append(held_ids)
        if len(ids) and queries:
            self.scores, self.ids = np.concatenate(scores), np.concatenate(found)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all that is held."""
        queries, width = self.scores.shape
        return np.repeat(np.arange(queries), width), self.ids.ravel(), self.scores.ravel()


class RunningTopK:
    """A task's best k of each query so far, ties by the smaller id."""

    def __init__(self, queries: int, k: int, metric: str | Metric):
        self.k, self.metric = k, parse(metric)
        self.scores = [np.zeros(0) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        if len(scores) > self.k:
            keys = badness(self.metric, scores)
            if self.k:
                border = np.partition(keys, self.k - 1)[self.k - 1]
                inside, at = np.flatnonzero(keys < border), np.flatnonzero(keys == border)
                at = at[np.argsort(ids[at], kind="stable")][: self.k - len(inside)]
                keep = np.concatenate([inside, at])
            else:
                keep = np.zeros(0, np.int64)
            scores, ids = scores[keep], ids[keep]
        self.scores[query], self.ids[query] = scores, ids

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all that is held."""
        sizes = [len(s) for s in self.scores]
        none = np.zeros(0)
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([none.astype(np.int64), *self.ids]), np.concatenate([none, *self.scores])
