"""Connected components of an edge table, by alternating star contractions, in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.session import cut


def local_forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node but the least of its component, with that least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _contract(batches):
    """Replaces a task's edges by stars around the least node of each of the task's own components."""
    import pyarrow as pa

    edges: list[tuple[int, int]] = []
    for b in batches:
        edges += zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)
        if len(edges) > 400_000:  # bounds a task's memory; what has met already stays joined
            edges = local_forest(edges)
            if len(edges) > 200_000:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in edges], "b": [y for _, y in edges]})
                edges = []
    edges = local_forest(edges)
    if edges:
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in edges], "b": [y for _, y in edges]})


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs: root is its component's least node.

    Each round replaces edges by stars: every node's larger neighbours join its least one (large star),
    then its smaller neighbours do (small star). Path lengths shrink by a constant factor a round, hubs
    are met by partial minima and joins that Spark may split. Loops and nulls are left out; an empty
    table gives an empty one.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # from here on every edge runs from a larger node a to a smaller node b
    now = cut(edges.mapInArrow(_contract, "a long, b long").distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        # stars do not change any more once every node has one edge and no centre is a leaf
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
