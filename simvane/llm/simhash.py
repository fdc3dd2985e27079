"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits fall into two halves of 32; of two fingerprints at most three bits apart, one
half differs in at most one bit. The anchors of a half are the words of the perfect (31, 26) Hamming
code over its first 31 bits: every value lies within the covering radius 1 of exactly one anchor, its
home. A fingerprint is replicated to its home and to the other anchors within radius plus threshold,
1 + 1 = 2; a close pair meets where one of them is at home. What meets at an anchor is compared in
full, all 64 bits, and joined to a forest there, so no pairs are listed. An anchor of very many
fingerprints is cut into chunks that are compared two by two in separate tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simvane.llm.components import connected_components
from simvane.session import cut, lean, share_path


@dataclass(frozen=True)
class Parameters:
    """``chunk`` fingerprints at most of one anchor are compared with as many others in one task."""

    shingle: int = 3
    distance: int = 3
    chunk: int = 4096
    seed: int = 42


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without a word."""
    words = (text or "").encode().lower().split()  # bytes: both touch ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for lo in range(0, n, step):
        hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts[lo : lo + step], ends[lo : lo + step], strict=True)), np.uint64, min(step, n - lo))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, p: Parameters = Parameters(), *more: str) -> DataFrame:
    """(doc_id, fp) and columns of longs that ``more`` names: the signed fingerprint of every whole text."""
    share_path(documents.sparkSession)
    names = ["doc_id", *more]

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), p.shingle, p.seed) for t in b["text"]), np.int64, len(b))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(found)], [*names, "fp"])

    return documents.select(*names, "text").mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*names, "fp"]))


def syndromes(values: np.ndarray) -> np.ndarray:
    """The (31, 26) Hamming code's parity check, where bit i carries the number i + 1: for each 31-bit value the number of the bit, from 1, to flip to reach its home anchor; 0 at an anchor."""
    out = np.zeros(len(values), np.uint32)
    for k in range(5):
        mask = np.uint32(sum(1 << i for i in range(31) if (i + 1) >> k & 1))
        x = values & mask
        for s in (16, 8, 4, 2, 1):
            x = x ^ (x >> np.uint32(s))
        out |= (x & np.uint32(1)) << np.uint32(k)
    return out


def _bit(numbers: np.ndarray) -> np.ndarray:
    """The word with the numbered bit set, bits counting from 1; nothing for 0."""
    return np.where(numbers > 0, np.uint32(1) << (np.maximum(numbers, 1) - 1).astype(np.uint32), 0).astype(np.uint32)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 31-bit values: the home anchor of each, and the matrix of the other anchors within distance 2.

    A word of weight 2 with bits a and b has the syndrome a ^ b, so the anchors at distance 2 flip the
    15 pairs with a ^ b = s for a syndrome s (16 pairs with one of them ``s`` alone, the home). An
    anchor itself (s = 0) has no other within 2: its row repeats the home.
    """
    s = syndromes(values)
    home = values ^ _bit(s)
    a = np.arange(1, 32, dtype=np.uint32)[None, :]
    b = a ^ s[:, None]
    first = (a < b) & (s[:, None] > 0)  # each pair once; b = 0 is the home itself
    reach = np.where(first, values[:, None] ^ _bit(a) ^ _bit(b), home[:, None])
    return home, reach


def replicate(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) of distinct fingerprints over both halves; the half is the anchor's top bit."""
    keys, owners, homes = [], [], []
    for half in (0, 1):
        values = ((fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        home, reach = anchors(values)
        other = reach != home[:, None]
        key = np.int64(half) << 40
        keys += [home.astype(np.int64) | key, reach[other].astype(np.int64) | key]
        owners += [fps, np.repeat(fps, other.sum(1))]
        homes += [np.ones(len(fps), bool), np.zeros(int(other.sum()), bool)]
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(homes)


def close_forest(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A forest (larger, smaller) over the fingerprints of left and right that joins all pairs within ``most`` bits of left x right."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = np.arange(len(nodes))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = inverse[len(left) :]
    width = max(1, (1 << 20) // max(1, len(right)))
    for lo in range(0, len(left), width):
        apart = np.bitwise_count(left[lo : lo + width, None].view(np.uint64) ^ right[None, :].view(np.uint64))
        close = apart <= most
        for i in np.flatnonzero(close.any(1)):
            mine = inverse[lo + i]
            met = np.unique(parent[at[close[i]]])  # few roots, however many are close
            for x in met:
                a, b = find(mine), find(int(x))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        for _ in range(40):  # point everything at its root, so that the roots met stay few
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    roots = np.array([find(i) for i in range(len(nodes))])
    rest = np.flatnonzero(roots != np.arange(len(nodes)))
    return list(zip(nodes[rest].tolist(), nodes[roots[rest]].tolist(), strict=True))


def close_edges(distinct: DataFrame, p: Parameters) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within the distance."""

    def spread(batches):
        for b in batches:
            fps = b["fp"].to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 20_000):
                key, fp, home = replicate(fps[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(home)], ["anchor", "fp", "home"])

    met = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    # an anchor without a home compares nothing; one with a single fingerprint neither
    sizes = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived")).where("lived AND n > 1")
    # written, so that the join alone deals by anchor: Spark may split a hot anchor's rows before they are cut into chunks
    sizes = cut(sizes.select("anchor", F.ceil(F.col("n") / p.chunk).cast("int").alias("chunks")))
    own = met.join(sizes, "anchor")
    # chunk i meets all chunks j: a home row is a left row of (i, j) for every j; any row is a right row of (i, j) for every i
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    left = own.where("home").select("anchor", chunk.alias("i"), F.explode(others).alias("j"), "fp", F.lit(True).alias("left"))
    right = own.select("anchor", F.explode(others).alias("i"), chunk.alias("j"), "fp", F.lit(False).alias("left"))
    distance = p.distance

    def compare(batches):
        """Rows come grouped by (anchor, i, j); groups may run over batches."""
        rest: list[np.ndarray] = []

        def closed(key, fp, is_left):
            edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]]), strict=True):
                side = is_left[lo:hi]
                f = fp[lo:hi]
                if side.any() and not side.all():
                    out += close_forest(f[side], f[~side], distance)
            return out

        def flush(key, fp, side):
            found = closed(key, fp, side)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for b in batches:
            key = np.stack([b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "i", "j")], 1)
            fp, side = b["fp"].to_numpy(zero_copy_only=False), b["left"].to_numpy(zero_copy_only=False)
            if rest:
                key, fp, side = np.concatenate([rest[0], key]), np.concatenate([rest[1], fp]), np.concatenate([rest[2], side])
            if not len(key):
                continue
            last = int(np.argmax((key == key[-1]).all(1)))  # sorted: where the last, still open group begins
            if last:
                yield from flush(key[:last], fp[:last], side[:last])
            rest = [key[last:], fp[last:], side[last:]]
        if rest and len(rest[0]):
            yield from flush(*rest)

    grouped = left.unionByName(right).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return grouped.mapInArrow(compare, "a long, b long")


def _classes(own: DataFrame, least: Column, p: Parameters) -> DataFrame:
    """(fp, least): for every fingerprint of ``own`` the least value of ``least`` in its component."""
    nodes = cut(own.groupBy("fp").agg(F.min(least).alias("least")))
    links = connected_components(close_edges(nodes, p))
    joined = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the join is the only one to deal by root: Spark may split a giant component's rows
    first = cut(joined.groupBy("root").agg(F.min("least").alias("first")))
    return joined.join(first, "root").select("fp", F.col("first").alias("least"))


def simhash_groups(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing bits,
    null only if a whole component has null ids. Null and wordless texts have the fingerprint zero and
    link like any other. Equal fingerprints are one node, however many documents share them; repeated
    rows each return. Other columns are never read.
    """
    own = cut(fingerprints(documents, p))
    classes = _classes(own, F.col("doc_id"), p).withColumnRenamed("least", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents' rows and columns, one for each component: that of the smallest doc_id.

    Null ids come last; of different texts under one id the one of the smaller hash stays, of repeated
    rows any one.
    """
    marked = documents.withColumn("__sv_twin", F.xxhash64("text"))
    own = cut(fingerprints(marked, p, "__sv_twin"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("__sv_twin"))
    chosen = _classes(own, place, p).select("least.*").distinct().select(F.col("doc_id").alias("__sv_id"), F.col("__sv_twin").alias("__sv_own"))
    kept = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col("__sv_id")) & (F.col("__sv_twin") == F.col("__sv_own")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__sv_twin"]).drop("__sv_twin")
