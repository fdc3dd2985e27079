"""Bounded samples of labelled documents, and the fixed held-out folds."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simvane.session import cut


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def class_sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids of each of the two classes, in the order of an id's hash.

    Returns (doc_id, y), of at most 2 * per_class rows plus ties of one id, and how many ids
    each class has. Ids labelled twice take the larger label; null ids and labels are left out.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    takes = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = [(r["doc_id"], r["y"]) for t in takes for r in t.collect()]
    return labels.sparkSession.createDataFrame(rows, "doc_id long, y int"), sizes


def sampled_features(documents: DataFrame, sample: DataFrame, featurise: Callable[[pa.Array], list[bytes]], most_bytes: int) -> list[tuple[int, int, pa.Buffer]]:
    """(doc_id, y, features) of the sampled documents, sorted by id; the features lie in Arrow's memory, held once.

    Of each class, rows come in the order of an id's hash while they have at most half of ``most_bytes``:
    few long texts then make up the sample, and neither their number nor their length fills the driver.
    """
    schema = "doc_id long, y int, features binary"

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 64):
                some = b.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["y"], pa.array(featurise(some["text"]), pa.binary())], ["doc_id", "y", "features"])

    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    made = cut(joined.select("doc_id", "y", "text").mapInArrow(run, schema).withColumn("__sv_row", F.monotonically_increasing_id()))
    # of no more rows than the sample has: a running sum is cheap, and what it chooses small
    size = F.length("features")
    slim = made.select("__sv_row", "doc_id", "y", size.alias("size"), F.sha2("features", 256).alias("twin"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "twin", "__sv_row").rowsBetween(Window.unboundedPreceding, 0)
    held = slim.withColumn("held", F.sum("size").over(order))
    chosen = held.where((F.col("held") <= most_bytes // 2) | (F.col("held") == F.col("size"))).select("__sv_row")
    found = made.join(F.broadcast(chosen), "__sv_row").select("doc_id", "y", "features").toArrow()
    rows = zip(found["doc_id"].to_pylist(), found["y"].to_pylist(), (x.as_buffer() for x in found["features"]), strict=True)
    return sorted(rows, key=lambda r: (r[0], r[1], zlib.crc32(r[2])))
