"""Near-duplicate embeddings by NN-descent.

Equal vectors become one node. Random hyperplanes deal the nodes into small leaves, several times over;
the best partners inside the leaves begin each node's neighbour list. A round then lets every node
introduce its neighbours, listed or listing it, to one another, but for pairs that have met there
before, and keeps the best in each list, until no list changes. Two links in a row span at most twice the threshold's angle, so partners farther away
are never listed. A list that is full of partners above the threshold is saturated: its length doubles,
and rounds go on, up to ``longest``.

The threshold edges are kept and join components: those in the lists, and a spanning forest of the
links of each block that was compared, so that no list's length cuts a link off. Nodes of lists still
saturated at ``longest`` search one another for links between components, in leaves and rounds of their
own, until there is none. A component's links are counted in blocks of near members,
never listed; a bound by the blocks' centres and radii tells which pairs of blocks hold all links, none,
or have to be compared. An audit compares fixed query sets with all vectors and starts over with more
leaves and rounds while too few nodes have all their links; after the last attempt all vectors are
compared with all.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.llm.components import connected_components
from simvane.llm.grouped import groups
from simvane.operators.vectors import listed
from simvane.session import cut, share_path

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Parameters:
    """``neighbours`` is a list's length to begin with and ``longest`` the one up to which saturated lists grow;
    ``leaf`` the size that trees aim at and ``block`` the most rows compared with each other at once, ``part``
    those of a component's blocks; ``trees`` is the least number of them, and as many grow as let a pair at the
    threshold share a leaf with a chance of ``shared``. Of ``audited`` vectors inside the
    largest component and outside it, ``recall`` of those with links must have all of them."""

    threshold: float = 0.9
    neighbours: int = 10
    longest: int = 20
    trees: int = 6
    shared: float = 0.98
    leaf: int = 512
    block: int = 1024
    part: int = 128
    rounds: int = 8
    audited: int = 512
    recall: float = 0.995
    attempts: int = 3
    exact: int = 8192
    seed: int = 5

    @property
    def reach(self) -> float:
        """The cosine of twice the threshold's angle: the least that two neighbours of one node can have."""
        return 2 * self.threshold**2 - 1 if self.threshold > 0 else -1.0


def _unit(rows: pa.ChunkedArray | pa.Array, width: str) -> np.ndarray:
    """Vectors of one dimension from their bytes, in double precision, brought to length 1."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = np.frombuffer(b"".join(rows.to_pylist()), width).reshape(len(rows), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(embeddings: DataFrame, width: str) -> DataFrame:
    """(vec_id, v): the components as bytes; v is null where the vector or its id can't link with anything."""
    kind = np.dtype(width)

    def run(batches):
        for b in batches:
            vectors = b["embedding"]
            values = vectors.flatten()  # without what null vectors hold
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0.0 becomes 0.0
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            ends = np.cumsum(lengths, dtype=np.int64)
            some = np.flatnonzero(lengths)
            # a norm in double precision neither overflows nor vanishes for components of any float; doubles are checked
            squares = np.zeros(len(b))
            with np.errstate(over="ignore", invalid="ignore"):
                squares[some] = np.add.reduceat(x.astype(np.float64) ** 2, (ends - lengths)[some]) if len(some) else 0
            null = ~((squares > 0) & np.isfinite(squares)) | b["vec_id"].is_null().to_numpy(zero_copy_only=False)
            raw = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(np.append(0, ends * kind.itemsize)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b["vec_id"], pc.if_else(pa.array(null), None, raw).cast(pa.binary())], ["vec_id", "v"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


#: Rows of a node's list, k its length, ``old`` if they stood there before a round; edges that are ``sure`` belong to a forest of links instead.
EDGES = "u long, v long, s double, k int, old boolean, sure boolean"
_TYPES = pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()
_Part = tuple[np.ndarray, ...]


def _listed(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: np.ndarray, old: np.ndarray) -> _Part:
    """Each node's k best distinct partners of those given, in order: (u, v, s, k, old)."""
    order = np.lexsort((-s, v, u))
    u, v, s, k, old = (x[order] for x in (u, v, s, k, old))
    first = np.flatnonzero((np.diff(u, prepend=u[:1] - 1) != 0) | (np.diff(v, prepend=v[:1] - 1) != 0))
    old = np.logical_or.reduceat(old, first) if len(first) else old
    u, v, s, k = u[first], v[first], s[first], k[first]
    order = np.lexsort((v, -s, u))
    u, v, s, k, old = (x[order] for x in (u, v, s, k, old))
    starts = np.flatnonzero(np.diff(u, prepend=u[:1] - 1))
    sizes = np.diff(starts, append=len(u))
    k = np.repeat(np.maximum.reduceat(k, starts), sizes) if len(starts) else k
    kept = np.arange(len(u)) - np.repeat(starts, sizes) < k
    return u[kept], v[kept], s[kept], k[kept], old[kept]


def _sent(parts: list[list[_Part]]) -> pa.RecordBatch:
    """The blocks' list edges, the best k of each node, and their forests."""
    lists, forests = (tuple(np.concatenate(x) for x in zip(*p, strict=True)) for p in zip(*parts, strict=True))
    lists = _listed(*lists, np.zeros(len(lists[0]), bool))
    n, m = len(lists[0]), len(forests[0])
    columns = [*(np.concatenate(x) for x in zip(lists, (*forests, np.zeros(m, np.int32), np.zeros(m, bool)), strict=True)), np.repeat([False, True], [n, m])]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], ["u", "v", "s", "k", "old", "sure"])


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric square of links, as index pairs."""
    left, a, b = near.any(1), [], []
    while left.any():
        held = [int(left.argmax())]
        left[held[0]] = False
        while held:
            i = held.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            a += [i] * len(new)
            b += new.tolist()
            held += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _compared(ids: np.ndarray, roots: np.ndarray, x: np.ndarray, p: Parameters, k: np.ndarray, worst: np.ndarray, fresh: np.ndarray | None = None) -> list[_Part]:
    """A block's best partners of other roots, in reach and a gain on ``worst``, and a spanning forest of its links.

    With ``fresh`` only pairs with a fresh side count: others have met here before.
    """
    scores = x @ x.T
    scores[roots[:, None] == roots[None, :]] = -3
    if fresh is not None:
        scores[~(fresh[:, None] | fresh[None, :])] = -3
    a, b = np.nonzero((scores >= p.reach) & (scores > worst[:, None]))
    s = scores[a, b]
    linked = np.flatnonzero((scores >= p.threshold).any(1))
    i, j = _spanning(scores[np.ix_(linked, linked)] >= p.threshold)
    i, j = linked[i], linked[j]
    best = _top(a, s, k)
    return [(ids[a[best]], ids[b[best]], s[best], k[a[best]]), (ids[i], ids[j], scores[i, j])]


def _top(rows: np.ndarray, scores: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The places of each row's best scores, k of its own; rows ascend."""
    order = np.lexsort((-scores, rows))
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return order[np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows))) < k[rows]]


def _blockwise(batches, keys: list[str], most: int | None, compare):
    """Sends what ``compare`` finds in each group of rows."""
    parts, rows = [], 0
    for _, t in groups(batches, keys, most):
        parts.append(compare(t))
        rows += len(parts[-1][0][0]) + len(parts[-1][1][0])
        if rows > 500_000 or len(parts) > 20_000:
            yield _sent(parts)
            parts, rows = [], 0
    if parts:
        yield _sent(parts)


def _bits(count: int, p: Parameters) -> int:
    return max(1, int(np.ceil(np.log2(max(2, count) / p.leaf)))) if count > p.leaf else 0


def tree_count(count: int, p: Parameters) -> int:
    """So many trees that a pair at the threshold shares a leaf in one of them with a chance of ``shared``."""
    together = (1 - np.arccos(np.clip(p.threshold, -1, 1)) / np.pi) ** _bits(count, p)
    return p.trees if together >= 1 else max(p.trees, int(np.ceil(np.log(1 - p.shared) / np.log(1 - together))))


#: More hyperplanes by which a leaf of too many rows is parted.
SPARE = 20


def leaf_edges(nodes: DataFrame, width: str, count: int, first: int, trees: int, p: Parameters) -> DataFrame:
    """EDGES of nodes (node, v, root) met in the leaves of trees ``first`` and on.

    Leaves of more than a block are parted by more hyperplanes; what still is too large, being all alike, at random.
    """
    bits = _bits(count, p)

    def deal(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        size = np.dtype(width).itemsize
        weights = np.int64(1) << np.arange(bits + SPARE, dtype=np.int64)
        for b in batches:
            lengths = np.array([len(x) for x in b["v"].to_pylist()])
            for length in np.unique(lengths):
                own = b.filter(pa.array(lengths == length))
                x = _unit(own["v"], width)
                for tree in range(first, first + trees):
                    if (key := (tree, int(length))) not in planes:
                        planes[key] = np.random.default_rng([p.seed, tree, int(length)]).normal(size=(int(length) // size, bits + SPARE))
                    code = ((x @ planes[key]) > 0) @ weights
                    leaf, spare = pa.array(code & ((1 << bits) - 1)), pa.array((code >> bits).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(np.full(len(x), length, np.int32)), leaf, spare, own["node"], own["v"], own["root"]], ["tree", "length", "leaf", "spare", "node", "v", "root"])

    dealt = nodes.select("node", "v", "root").mapInArrow(deal, "tree int, length int, leaf long, spare int, node long, v binary, root long")
    leaf = ["tree", "length", "leaf"]
    more = F.least(F.lit(SPARE), F.ceil(F.log2(F.col("n") / p.block))).cast("int")
    large = dealt.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.block).select(*leaf, F.expr("1").alias("one"), more.alias("more"))
    part = F.coalesce(F.expr("spare & (shiftleft(1, more) - 1)"), F.lit(0))
    placed = dealt.join(large, leaf, "left").select(*leaf, part.alias("part"), "node", "v", "root")

    def compare(t: pa.Table) -> list[_Part]:
        n = len(t)
        return _compared(t["node"].to_numpy(), t["root"].to_numpy(), _unit(t["v"], width), p, np.full(n, p.neighbours, np.int32), np.full(n, -2.0))

    keys = [*leaf, "part"]
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("node"))
    return dealt.mapInArrow(lambda batches: _blockwise(batches, keys, 2 * p.block, compare), EDGES)


LISTS = "u long, v long, s double, worst double, k int, old boolean"


def best_lists(edges: DataFrame, p: Parameters) -> DataFrame:
    """LISTS: each node's k best distinct partners; worst is the last one's score in a full list, else -2.

    Saturated lists, full of links, get twice the length up to ``longest``, and are no longer full then.
    """

    def close(parts: list[_Part]) -> pa.RecordBatch:
        u, v, s, k, old = _listed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        starts = np.flatnonzero(np.diff(u, prepend=u[:1] - 1))
        sizes = np.diff(starts, append=len(u))
        last, length = s[starts + sizes - 1], k[starts]
        worst = np.where(sizes >= length, last, -2.0)
        grows = (worst >= p.threshold) & (length < p.longest)
        length = np.where(grows, np.minimum(2 * length, p.longest), length)
        worst[grows] = -2.0
        old = old & ~np.repeat(grows, sizes)  # what has met without a gain may gain now
        columns = [u, v, s, np.repeat(worst, sizes), np.repeat(length, sizes), old]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (*_TYPES[:3], pa.float64(), pa.int32(), pa.bool_()), strict=True)], ["u", "v", "s", "worst", "k", "old"])

    def trim(batches):
        parts: list[_Part] = []
        for b in batches:
            if not len(b):
                continue
            new = tuple(b[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "s", "k", "old"))
            last = int(np.searchsorted(new[0], new[0][-1]))  # where the last, still open node begins
            if last:
                yield close([*parts, tuple(x[:last] for x in new)])
                parts = []
            elif parts and parts[0][0][0] != new[0][0]:
                yield close(parts)
                parts = []
            parts.append(tuple(x[last:] for x in new))
            if sum(len(x[0]) for x in parts) > 100_000:  # a node that very many blocks know
                parts = [_listed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        if parts:
            yield close(parts)

    return edges.select("u", "v", "s", "k", "old").repartition("u").sortWithinPartitions("u").mapInArrow(trim, LISTS)


def introduced(lists: DataFrame, nodes: DataFrame, width: str, p: Parameters) -> DataFrame:
    """EDGES: pairs of other roots that a common neighbour introduces, where one side's list would gain.

    A host's guests beyond a block are cut into blocks that meet two by two.
    """
    state = lists.groupBy("u").agg(F.max("worst").alias("worst"), F.max("k").alias("k")).withColumnRenamed("u", "node")
    known = nodes.select("node", "v", "root").join(state, "node", "left")
    known = known.select("node", F.col("v").alias("vector"), "root", F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("k", F.lit(p.neighbours)).alias("k"))
    listed = lists.select("u", "v", "old")
    both = listed.unionByName(listed.select(F.col("v").alias("u"), F.col("u").alias("v"), "old"))
    links = both.groupBy("u", F.col("v").alias("host")).agg((~F.min("old")).alias("fresh"))
    guests = links.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("some")).where("n > 1 AND some").select("host", F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))
    sent = links.join(guests, "host").join(known, F.col("u") == F.col("node"))
    sent = sent.withColumn("own", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("host", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("u").alias("guest"), "vector", "root", "worst", "k", "fresh")

    def compare(t: pa.Table) -> list[_Part]:
        return _compared(t["guest"].to_numpy(), t["root"].to_numpy(), _unit(t["vector"], width), p, t["k"].to_numpy(), t["worst"].to_numpy(), t["fresh"].to_numpy(zero_copy_only=False))

    keys = ["host", "i", "j"]
    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _blockwise(batches, keys, None, compare), EDGES)


def descend(nodes: DataFrame, lists: DataFrame | None, width: str, total: int, first: int, trees: int, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Lists of the best partners of other roots, after leaves and rounds, and the threshold edges (a, b) that were met."""
    flat = lambda t, old=False: t.select("u", "v", "s", "k", F.lit(old).alias("old"))
    state = lambda t: tuple(t.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.lit(1)), F.sum("k")).first())
    edges = cut(leaf_edges(nodes, width, total, first, trees, p))
    forests = [edges.where("sure").select("u", "v")]
    edges = flat(edges.where("NOT sure"))
    now = cut(best_lists(edges if lists is None else edges.unionByName(flat(lists, True)), p))
    after = state(now)
    for _ in range(p.rounds if after[1] else 0):
        before, new = after, cut(introduced(now, nodes, width, p))
        forests.append(new.where("sure").select("u", "v"))
        now = cut(best_lists(flat(now, True).unionByName(flat(new.where("NOT sure"))), p))
        after = state(now)
        if after == before:
            break
    met = [*forests, now.where(F.col("s") >= p.threshold).select("u", "v")]
    return now, reduce(DataFrame.unionByName, met).select(F.col("u").alias("a"), F.col("v").alias("b"))


def exact_forest(nodes: DataFrame, width: str, total: int, p: Parameters) -> DataFrame:
    """A forest (a, b) of all links: parts of ``exact`` vectors go out one after another and meet every vector."""
    found = []
    parts = max(1, -(-total // p.exact))
    for part in range(parts):
        rows = [(r["node"], bytes(r["v"])) for r in nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part).select("node", "v").collect()]
        by_length = {}
        for length in {len(v) for _, v in rows}:
            own = [(n, v) for n, v in rows if len(v) == length]
            by_length[length] = np.array([n for n, _ in own]), pa.array([v for _, v in own], pa.binary())
        sent = nodes.sparkSession.sparkContext.broadcast(by_length)

        def meet(batches, sent=sent):
            against = {length: (n, _unit(v, width), np.arange(len(n))) for length, (n, v) in sent.value.items()}
            for b in batches:
                lengths, pairs = np.array([len(x) for x in b["v"].to_pylist()]), ([], [])
                for length, (others, y, label) in against.items():
                    own = b.filter(pa.array(lengths == length))
                    for lo in range(0, len(own), 256):
                        some = own.slice(lo, 256)
                        near = _unit(some["v"], width) @ y.T >= p.threshold
                        ids = some["node"].to_numpy(zero_copy_only=False)
                        for r in np.flatnonzero(near.any(1)):
                            at = np.flatnonzero(near[r])
                            apart, one = np.unique(label[at], return_index=True)  # one partner of each set that hasn't met yet
                            pairs[0].append(np.full(len(one), ids[r]))
                            pairs[1].append(others[at[one]])
                            if len(apart) > 1:
                                label[np.isin(label, apart)] = apart[0]
                if pairs[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in pairs], ["a", "b"])

        found.append(cut(nodes.select("node", "v").mapInArrow(meet, "a long, b long").where("a <> b")))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)


def blocks_of(roots: DataFrame, nodes: DataFrame, width: str, p: Parameters) -> DataFrame:
    """(root, block, node, v, copies): components in blocks of near members.

    Planes cut a large component, as many as bring its cells near the size of a block, each somewhere about its
    middle; chance parts a cell that still is too large.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.greatest(F.lit(0), F.least(F.lit(SPARE), F.ceil(F.log2(F.col("n") / p.part)))).cast("int").alias("bits"))
    member = cut(roots.join(sizes, "root").join(nodes, "node").select("root", "node", "v", "copies", "bits"))

    def project(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = np.array([len(x) for x in b["v"].to_pylist()])
            for length in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == length))
                if length not in planes:
                    planes[length] = np.random.default_rng([p.seed, length]).normal(size=(length // np.dtype(width).itemsize, SPARE))
                found = _unit(own["v"], width) @ planes[length]
                yield pa.RecordBatch.from_arrays([own["root"], own["node"], own["bits"], listed(found)], ["root", "node", "bits", "along"])

    along = cut(member.where("bits > 0").mapInArrow(project, "root long, node long, bits int, along array<double>"))
    at = np.random.default_rng(p.seed).normal(size=SPARE) * 0.8
    middle = [F.avg(F.col("along")[i]) + F.coalesce(F.stddev_pop(F.col("along")[i]), F.lit(0.0)) * float(at[i]) for i in range(SPARE)]
    middles = cut(along.groupBy("root").agg(F.array(*middle).alias("cuts")))
    code = F.aggregate(F.zip_with("along", "cuts", lambda x, y: F.when(x > y, 1).otherwise(0)), F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("c")), lambda acc, x: F.struct((acc["i"] + 1).alias("i"), F.when(acc["i"] < F.col("bits"), acc["c"] * 2 + x).otherwise(acc["c"]).cast("long").alias("c")), lambda acc: acc["c"])
    cells = along.join(middles, "root").select("root", "node", code.alias("code"))
    large = cells.groupBy("root", "code").agg(F.ceil(F.count(F.lit(1)) / p.part).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = cells.join(large, ["root", "code"]).select("node", (F.col("code") + F.shiftleft(part, SPARE)).alias("block"))
    return member.join(placed, "node", "left").select("root", F.coalesce("block", F.lit(0)).cast("long").alias("block"), "node", "v", "copies")


def block_pairs(members: DataFrame, width: str, p: Parameters) -> DataFrame:
    """(root, i, j, whole): pairs of a component's blocks, i <= j, that may hold links; all their pairs link where ``whole``."""
    reach = float(np.arccos(np.clip(p.threshold, -1, 1)))

    def measure(batches):
        for (root, block), t in groups(batches, ["root", "block"]):
            x = _unit(t["v"], width)
            centre = x.mean(0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else x[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(root), int(block), centre.tobytes(), radius)], ["root", "block", "centre", "radius"])

    keys = ["root", "block"]
    measured = members.select(*keys, "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(measure, "root long, block long, centre binary, radius double")
    measured = cut(measured)
    a = measured.select("root", F.col("block").alias("i"), F.col("centre").alias("a"), F.col("radius").alias("r"))
    b = measured.select("root", F.col("block").alias("j"), F.col("centre").alias("b"), F.col("radius").alias("q"))

    def bound(batches):
        for t in batches:
            apart = np.array([np.arccos(np.clip(np.frombuffer(x) @ np.frombuffer(y), -1, 1)) for x, y in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)])
            spare = t["r"].to_numpy() + t["q"].to_numpy() + 1e-6  # beyond what rounding can do to an angle
            whole = pa.array(apart + spare <= reach) if len(t) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([t["root"], t["i"], t["j"], whole], ["root", "i", "j", "whole"]).filter(pa.array(apart - spare <= reach) if len(t) else pa.array([], pa.bool_()))

    return a.join(b, "root").where("i <= j").mapInArrow(bound, "root long, i long, j long, whole boolean")


def link_counts(nodes: DataFrame, roots: DataFrame, width: str, p: Parameters) -> DataFrame:
    """(node, links): for nodes of a component how many other nodes' vectors, copies included, reach the threshold."""
    members = cut(blocks_of(roots, nodes, width, p))
    pairs = cut(block_pairs(members, width, p))
    sizes = members.groupBy("root", "block").agg(F.sum("copies").alias("held"))
    whole = pairs.where("whole")
    sides = whole.select("root", F.col("i").alias("block"), F.col("j").alias("other")).unionByName(whole.where("i <> j").select("root", F.col("j").alias("block"), F.col("i").alias("other")))
    linked = sides.join(sizes.withColumnRenamed("block", "other"), ["root", "other"]).groupBy("root", "block")
    linked = linked.agg(F.sum("held").alias("held"), F.max(F.col("other") == F.col("block")).alias("own"))
    sure = members.join(linked, ["root", "block"]).select("node", (F.col("held") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))
    open_ = pairs.where("NOT whole").drop("whole")
    left = members.join(open_.withColumnRenamed("i", "block"), ["root", "block"]).select("root", F.col("block").alias("i"), "j", F.lit(True).alias("first"), "node", "v", "copies")
    right = members.join(open_.where("i <> j").withColumnRenamed("j", "block"), ["root", "block"]).select("root", "i", F.col("block").alias("j"), F.lit(False).alias("first"), "node", "v", "copies")

    def count(batches):
        ids, links = [], []
        for (_, i, j), t in groups(batches, ["root", "i", "j"]):
            x, n, c, side = _unit(t["v"], width), t["node"].to_numpy(), t["copies"].to_numpy(), t["first"].to_numpy(zero_copy_only=False)
            if i == j:
                near = x @ x.T >= p.threshold
                np.fill_diagonal(near, False)
                found = [(n, near @ c)]
            else:
                near = x[side] @ x[~side].T >= p.threshold
                found = [(n[side], near @ c[~side]), (n[~side], c[side] @ near)]
            for a, b in found:
                ids.append(a)
                links.append(b)
            if len(ids) > 200:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])
                ids, links = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])

    grouped = left.unionByName(right).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return grouped.mapInArrow(count, "node long, links long").unionByName(sure).groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, roots: DataFrame, found: DataFrame, width: str, p: Parameters) -> float:
    """The share of audited nodes with links, against all vectors, that have all of them in ``found`` (node, links); 1 without links.

    The largest component's nodes and all others are audited apart, each by a fixed query set, and the lesser share counts.
    """
    top = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").first()
    inside = F.coalesce(F.col("root") == (-1 if top is None else top["root"]), F.lit(False))
    known = nodes.join(roots, "node", "left").withColumn("largest", inside)
    asked = [(r["node"], bytes(r["v"]), r["largest"]) for part in ("largest", "NOT largest") for r in known.where(part).orderBy(F.xxhash64("v"), "node").limit(p.audited).select("node", "v", "largest").collect()]
    largest = [n for n, _, x in asked if x]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(v) for _, v, _ in asked}:
        own = [(n, v) for n, v, _ in asked if len(v) == length]
        by_length[length] = np.array([n for n, _ in own]), _unit(pa.array([v for _, v in own], pa.binary()), width)
    queries = nodes.sparkSession.sparkContext.broadcast(by_length)

    def count(batches):
        total: dict[int, int] = {}
        for b in batches:
            lengths = np.array([len(x) for x in b["v"].to_pylist()])
            for length, (ids, q) in queries.value.items():
                own = b.filter(pa.array(lengths == length))
                if len(own):
                    n = own["node"].to_numpy(zero_copy_only=False)
                    near = (_unit(own["v"], width) @ q.T >= p.threshold) & (n[:, None] != ids[None, :])
                    for i, k in zip(ids.tolist(), (own["copies"].to_numpy(zero_copy_only=False) @ near).tolist(), strict=True):
                        total[i] = total.get(i, 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "true"])

    truth = nodes.mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")).where(F.col("true") > 0)
    rows = truth.join(found, "node", "left").select("node", (F.coalesce("links", F.lit(0)) >= F.col("true")).alias("whole")).collect()
    shares = [np.mean(x) for side in (True, False) if (x := [r["whole"] for r in rows if (r["node"] in largest) == side])]
    return float(min(shares, default=1.0))


def embedding_groups(embeddings: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id and kept (vec_id = component_id).

    Vectors link if both are of one dimension and their cosine, in double precision, reaches the
    threshold. Vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null id, link with nothing: n_links 0, their own id as component, kept unless the id is null.
    Repeated rows are vectors of their own and link with each other. Other columns are never read.
    """
    share_path(embeddings.sparkSession)
    width = "<f8" if "double" in dict(embeddings.dtypes)["embedding"] else "<f4"
    rows = cut(prepared(embeddings, width))
    nodes = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    trees, tree = tree_count(total, p), 0
    alone = nodes.select("node", "v", F.col("node").alias("root"))
    lists, forests = None, []

    def joined_up() -> tuple[DataFrame, DataFrame]:
        roots = cut(connected_components(reduce(DataFrame.unionByName, forests)))
        return roots, nodes.select("node", "v").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    for attempt in range(p.attempts):
        lists, met = descend(alone, lists, width, total, tree, trees, p)
        tree += trees
        forests.append(met)
        roots, own = joined_up()
        # leaves that hold all nodes have compared all of them; else two lists that are saturated at their longest may hide a link
        stuck = cut(lists.where(F.col("worst") >= p.threshold).select(F.col("u").alias("node")).distinct())
        left = stuck.count() if total > min(p.leaf, p.block) else 0
        while left:
            more = tree_count(left, p)
            _, met = descend(own.join(stuck, "node"), None, width, left, tree, more, p)
            tree += more
            if met.isEmpty():
                break
            forests.append(met)
            roots, own = joined_up()
        counts = cut(link_counts(nodes, roots, width, p))
        recall = audit(nodes, roots, counts, width, p)
        _log.info("attempt %d found all links of %.4f of the audited vectors", attempt + 1, recall)
        if recall >= p.recall:
            break
    else:
        _log.warning("all links of %.4f of the audited vectors were found, %.4f were asked for: all vectors are compared", recall, p.recall)
        forests = [exact_forest(nodes, width, total, p)]
        roots, _ = joined_up()
        counts = cut(link_counts(nodes, roots, width, p))
    joined = nodes.join(roots, "node", "left").join(counts, "node", "left").select("v", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = cut(joined.groupBy("root").agg(F.min("least").alias("component")))  # the join alone deals by root, so that Spark may split a giant component
    classes = joined.join(least, "root").select("v", "n_links", "component")
    out = rows.join(classes, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
