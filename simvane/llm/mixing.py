"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent from 0 (all alike) to 1 (as they
are), brought to sum 1. Bisection finds the exponent nearest 1 at which the weights' entropy reaches a
target; a limit on how often a text may be repeated can keep it nearer to 1. Each source's budget is
then dealt out in passes: a pass is a pseudo-random permutation of the source's documents, the last
one ends where the budget does. Going along these permutations, each source fills its share of one
block after another, so any run of whole blocks keeps the weights; within a block the order is random.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simvane.session import cut

_WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("epoch", "block")


@dataclass(frozen=True)
class Parameters:
    """``entropy`` is the target as a share of the greatest possible; ``budget`` None means just enough tokens
    that no document is left out. ``bucket`` rows of a source are put in order together; ``most_sources``
    bounds what the driver holds, more than that is an error."""

    entropy: float = 0.92
    repetitions: float = 2.0
    budget: int | None = None
    block: int = 1_000_000
    bucket: int = 2_000
    seed: int = 1
    most_sources: int = 100_000


@dataclass(frozen=True)
class Share:
    """A source's weight, its passes over all documents, the tokens of a last partial pass, and its tokens a block."""

    weight: float
    passes: int
    rest: int
    width: int


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised] if total else [0.0] * len(tokens)


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def least_budget(tokens: list[int], w: list[float]) -> float:
    """Tokens of the smallest mixture in which each source has one whole pass or more."""
    return max((t / x for t, x in zip(tokens, w, strict=True) if x > 0), default=0.0)


def _bisect(holds: Callable[[float], bool]) -> float:
    """The largest exponent in [0, 1] at which a condition holds that holds from 0 up to it, to 6 digits."""
    low, high = 0, 1_000_000
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle / 1e6) else (low, middle)
    return low / 1e6


def exponent(tokens: list[int], p: Parameters) -> float:
    """Nearest 1 that meets the entropy; but no nearer 0 than the limit on repetitions allows."""
    some = [t for t in tokens if t > 0]
    if len(some) < 2:
        return 1.0
    target = p.entropy * math.log(len(some))

    def repeated(a: float) -> float:
        w = weights(some, a)
        budget = p.budget or least_budget(some, w)
        return max(budget * x / t for x, t in zip(w, some, strict=True))

    wanted = 1.0 if entropy(weights(some, 1.0)) >= target else _bisect(lambda a: entropy(weights(some, a)) >= target)
    if repeated(wanted) <= p.repetitions:
        return wanted
    # repetitions fall as the exponent rises: the first exponent from below at which they are few enough
    return round(_bisect(lambda a: repeated(a) > p.repetitions) + 1e-6, 6)


def shares(tokens: list[int], p: Parameters) -> list[Share]:
    """Each source's part of the mixture; a source without tokens keeps its documents once."""
    w = weights(tokens, exponent(tokens, p))
    budget = p.budget or least_budget(tokens, w)
    out = []
    for t, x in zip(tokens, w, strict=True):
        repeats = round(budget * x / t, 9) if t else 1.0
        passes = math.floor(repeats)
        out.append(Share(x, passes, math.floor((repeats - passes) * t + 0.5), max(1, math.floor(x * p.block + 0.5))))
    return out


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def mix(documents: DataFrame, p: Parameters = Parameters(), tokens: str | None = None) -> DataFrame:
    """The mixture's rows: the documents' columns, ``epoch`` (0 for a document's first use) and ``block``.

    Tokens are the column ``tokens``, else the words of ``text``. A null source is a source; null texts
    have no tokens and go along; repeated rows are documents of their own. Order follows a hash of the
    seed, the epoch and doc_id, or for a null id the text; equal hashes go by doc_id and tokens. Columns
    of the documents named like the added ones are replaced. An empty table gives an empty mixture.
    """
    base = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ADDED])
    identity = [F.col("doc_id").cast("string"), *([F.md5(F.col("text").cast("binary"))] if "text" in base.columns else []), F.lit("")]
    counted = base.withColumns({"__sv_tokens": F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else count_words(F.col("text")), "__sv_key": F.coalesce(*identity)})
    slim = cut(counted.select("source", "__sv_tokens", "__sv_key"))  # read twice, where texts would be counted anew
    totals = slim.groupBy("source").agg(F.sum("__sv_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(p.most_sources + 1).collect()
    if len(totals) > p.most_sources:
        raise ValueError(f"more than {p.most_sources} sources")
    totals.sort(key=lambda r: (r["source"] is not None, r["source"]))
    table = [(r["source"], i, r["t"], s.passes, s.rest, s.width, max(1, -(-r["n"] // p.bucket))) for i, (r, s) in enumerate(zip(totals, shares([r["t"] for r in totals], p), strict=True))]
    plan = documents.sparkSession.createDataFrame(table, "__sv_source string, __sv_sid int, __sv_total long, __sv_passes int, __sv_rest long, __sv_width long, __sv_buckets long")
    last = F.col("__sv_passes") - F.when(F.col("__sv_rest") > 0, 0).otherwise(1)

    def used(df: DataFrame) -> DataFrame:
        """A row for each pass of a document, with its order and bucket in that pass."""
        # at most ``most_sources`` short rows are broadcast
        planned = df.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__sv_source"))).where(last >= 0)
        passed = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        passed = passed.withColumn("__sv_h", F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.col("epoch").cast("string"), "__sv_key").cast("binary")))
        return passed.withColumn("__sv_bucket", F.floor(F.conv(F.substring("__sv_h", 1, 8), 16, 10).cast("long") * F.col("__sv_buckets") / F.lit(2.0**32)).cast("long"))

    key = ["__sv_sid", "epoch", "__sv_bucket"]
    # tokens before a document: those of the buckets before its own, and of those before it in there
    sums = used(slim).groupBy(*key).agg(F.sum("__sv_tokens").alias("__sv_sum"))
    before = F.sum("__sv_sum").over(Window.partitionBy("__sv_sid", "epoch").orderBy("__sv_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*key, F.coalesce(before, F.lit(0)).alias("__sv_start"))
    inside = F.sum("__sv_tokens").over(Window.partitionBy(*key).orderBy("__sv_h", "doc_id", "__sv_tokens").rowsBetween(Window.unboundedPreceding, -1))
    placed = used(counted).withColumn("__sv_inside", F.coalesce(inside, F.lit(0))).join(starts, key).withColumn("__sv_at", F.col("__sv_start") + F.col("__sv_inside"))
    kept = placed.where((F.col("epoch") < F.col("__sv_passes")) | (F.col("__sv_at") < F.col("__sv_rest")))
    block = F.floor((F.col("epoch") * F.col("__sv_total") + F.col("__sv_at")) / F.col("__sv_width")).cast("long")
    return kept.select(*[F.col(f"`{c}`") for c in base.columns], F.col("epoch").cast("int").alias("epoch"), block.alias("block"))


def schedule(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The mixture without texts: doc_id, source, n_tokens, epoch, block and the place in the block, from 1."""
    slim = cut(documents.select("doc_id", "source", count_words(F.col("text")).alias("n_tokens")))
    mixed = mix(slim, p, "n_tokens")
    order = F.md5(F.concat_ws(":", F.lit("place"), F.lit(str(p.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(order, "epoch", "doc_id"))
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block", place.alias("place"))


def oracle_sql(p: Parameters = Parameters()) -> str:
    """What ``schedule`` returns for documents with distinct ids, at least two sources with tokens and the default budget."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents
), src AS (
  SELECT source, sum(n)::BIGINT AS t, sum(n) / (SELECT sum(n) FROM d)::DOUBLE AS s FROM d GROUP BY source
), ent(lo, hi, i) AS (
  SELECT 0, 1000000, 0
  UNION ALL
  SELECT CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END, i + 1 FROM (
    SELECT lo, hi, i, m, (SELECT ln(sum(pow(s, m / 1e6))) - sum(pow(s, m / 1e6) * (m / 1e6) * ln(s)) / sum(pow(s, m / 1e6)) FROM src WHERE t > 0)
      >= {p.entropy} * ln((SELECT count(*) FROM src WHERE t > 0)) AS ok
    FROM (SELECT lo, hi, i, (lo + hi) // 2 AS m FROM ent WHERE hi - lo > 1)
  )
), rep(lo, hi, i) AS (
  SELECT 0, 1000000, 0
  UNION ALL
  SELECT CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END, i + 1 FROM (
    SELECT lo, hi, i, m, (SELECT pow(max(s) / min(s), 1 - m / 1e6) FROM src WHERE t > 0) > {p.repetitions} AS ok
    FROM (SELECT lo, hi, i, (lo + hi) // 2 AS m FROM rep WHERE hi - lo > 1)
  )
), expo AS (
  SELECT CASE
    WHEN (SELECT -sum(s * ln(s)) FROM src WHERE t > 0) >= {p.entropy} * ln((SELECT count(*) FROM src WHERE t > 0)) THEN 1.0
    ELSE greatest((SELECT arg_max(lo, i) FROM ent), CASE WHEN (SELECT pow(max(s) / min(s), 1 - (SELECT arg_max(lo, i) FROM ent) / 1e6) FROM src WHERE t > 0) > {p.repetitions} THEN (SELECT arg_max(lo, i) + 1 FROM rep) ELSE 0 END) / 1e6
  END AS a
), w AS (
  SELECT source, t, CASE WHEN t > 0 THEN pow(s, a) ELSE 0 END / sum(CASE WHEN t > 0 THEN pow(s, a) ELSE 0 END) OVER () AS w FROM src, expo
), plan AS (
  SELECT source, t, w, floor(reps)::BIGINT AS passes, floor((reps - floor(reps)) * t + 0.5)::BIGINT AS rest, greatest(1, floor(w * {p.block} + 0.5))::BIGINT AS width
  FROM (SELECT *, CASE WHEN t > 0 THEN round((SELECT max(t / w) FROM w WHERE w > 0) * w / t, 9) ELSE 1 END AS reps FROM w)
), used AS (
  SELECT d.*, p.t, passes, rest, width, unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY md5('{p.seed}:' || epoch || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM used
)
SELECT doc_id, source, n AS n_tokens, epoch::INTEGER AS epoch, (epoch * t + pos) // width AS block,
  row_number() OVER (PARTITION BY (epoch * t + pos) // width ORDER BY md5('place:{p.seed}:' || epoch || ':' || doc_id), epoch, doc_id)::INTEGER AS place
FROM placed WHERE epoch < passes OR pos < rest
"""
