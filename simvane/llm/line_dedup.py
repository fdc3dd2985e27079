"""Line deduplication by overlapping windows of three consecutive lines, in DataFrame operations alone.

Lines with a character other than white space count; each three in a row form a window. A window that
occurs again, anywhere in the corpus, is a later occurrence unless it stands first by (doc_id, position);
all lines that later occurrences cover go. Every line that goes therefore stands earlier in the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line counts if it has a character beyond ASCII white space.
_SOLID = r"[^\\x20\\x09-\\x0D]"
_ID, _TEXT = "doc_id", "text"


def windows(documents: DataFrame) -> DataFrame:
    """(doc_id, twin, w, lines, k1, k2) of every window: its place w, its three line numbers and a 128-bit key.

    ``twin`` tells apart different texts of one id. Lines are hashed once; a window's key hashes its lines' hashes.
    """
    marked = documents.select(
        _ID,
        F.xxhash64(_TEXT).alias("twin"),
        F.expr(rf"filter(transform(split({_TEXT}, '\n', -1), (x, i) -> struct(i AS p, xxhash64(x) AS a, xxhash64(x, 7L) AS b, x RLIKE '{_SOLID}' AS solid)), s -> s.solid)").alias("s"),
    ).where(F.size("s") >= 3)
    zipped = F.arrays_zip(*(F.expr(f"slice(s, {i}, size(s) - 2)").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))))
    exploded = marked.select(_ID, "twin", F.posexplode(zipped).alias("w", "v"))
    return exploded.select(
        _ID,
        "twin",
        "w",
        F.array("v.x.p", "v.y.p", "v.z.p").alias("lines"),
        F.xxhash64("v.x.a", "v.y.a", "v.z.a").alias("k1"),
        F.xxhash64("v.x.b", "v.y.b", "v.z.b").alias("k2"),
    )


def covered_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, twin, covered): the line numbers that later occurrences of windows cover, merged for each document."""
    found = windows(documents)
    place = F.struct(F.col(_ID).isNull().alias("last"), F.col(_ID), F.col("twin"), F.col("w"))
    # a map-side minimum and count stand before the shuffle, so a window in every document moves as one row a task
    repeated = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "first")
    later = found.join(repeated, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select(_ID, "twin", F.explode("lines").alias("p")).groupBy(_ID, "twin").agg(F.collect_set("p").alias("covered"))


def line_dedup(documents: DataFrame) -> DataFrame:
    """All documents and columns, ``text`` without the covered lines, and n_lines and n_removed added.

    Order is by doc_id, nulls last, then by a hash of the text, then by position; rows alike in id and
    text are one document, so all of them keep or lose the same lines. A null text stays null with no
    lines; texts of fewer than three solid lines, and blank lines that no window spans, stay as they are.
    A document that loses every line keeps its row with what blank lines it has. Columns of the
    documents named n_lines or n_removed are replaced.
    """
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_lines", "n_removed")]
    base = documents.select(*kept)
    covered = covered_lines(documents.select(_ID, _TEXT)).select(F.col(_ID).alias("__sv_id"), F.col("twin").alias("__sv_twin"), F.col("covered").alias("__sv_covered"))
    joined = base.withColumn("__sv_own", F.xxhash64(_TEXT)).join(covered, F.col(_ID).eqNullSafe(F.col("__sv_id")) & (F.col("__sv_own") == F.col("__sv_twin")), "left")
    changed = F.col("__sv_covered").isNotNull()
    parts = joined.withColumn("__sv_lines", F.when(changed, F.split(_TEXT, "\n", -1)))
    rest = F.expr(r"array_join(transform(array_except(sequence(0, size(__sv_lines) - 1), __sv_covered), p -> __sv_lines[p]), '\n')")
    count = F.length(_TEXT) - F.length(F.replace(F.col(_TEXT), F.lit("\n"), F.lit(""))) + 1
    return parts.select(
        *(F.when(changed, rest).otherwise(F.col(_TEXT)).alias(_TEXT) if c == _TEXT else F.col(f"`{c}`") for c in base.columns),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"),
        F.when(changed, F.size("__sv_covered")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


#: What ``line_dedup`` returns for documents with distinct ids, as (doc_id, text, n_lines, n_removed).
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents
), solid AS (
  SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), win AS (
  SELECT doc_id, w, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c, p, lead(p, 1) OVER d AS q, lead(p, 2) OVER d AS r
  FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY w)
), later AS (
  SELECT doc_id, p, q, r FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, w) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest([p, q, r]) AS p FROM later
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text FROM lines l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
