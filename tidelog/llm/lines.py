"""Line deduplication by site-relative frequency.

Pages are grouped by host; a line's ratio is the share of its host's pages that contain it, and lines above
``ratio`` on at least ``min_pages`` pages are boilerplate there and are dropped.  All of it is DataFrame code.

Counting shuffles 16 bytes a distinct line of a page (two 64-bit hashes), summed before they move, so a line
or a host on a third of all pages is counted where it lies.  A host has at most (distinct lines a page) /
``ratio`` boilerplate lines; if all of them together are few enough (they are counted first) they are
broadcast and the texts are not shuffled at all, otherwise texts join them by host and adaptive execution
splits a hot host.

Defined results: a null text stays null and counts as a page without lines; blank lines are never
boilerplate; lines are compared exactly, a line counts once a page however often the page repeats it; null
hosts are one host; repeated rows are separate pages; a text of which all lines go becomes empty, its row
stays; every other column is passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Boilerplate lines (16 bytes each) that may be broadcast.
BROADCAST_LINES = 500_000


def host_of(url: Column | str) -> Column:
    """The lower-case host of a URL; null if it has none."""
    found = F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, host: Column, text: Column, *, ratio: float, min_pages: int) -> DataFrame:
    """(host, a, b): the hashes of each host's boilerplate lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    kept = pages.select(host.alias("host"), F.array_distinct(F.transform(lines, _key)).alias("keys"))
    totals = kept.groupBy("host").agg(F.count("*").alias("pages"))
    counts = kept.select("host", F.explode("keys").alias("key")).select("host", "key.a", "key.b").groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("pages") * ratio).select("host", "a", "b")


def drop_boilerplate(pages: DataFrame, *, host: Column | str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 2, counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text; ``counts`` names columns for lines and lines dropped."""
    host = F.col(host) if isinstance(host, str) else host
    text = F.col(text_col)
    found = boilerplate(pages, host, text, ratio=ratio, min_pages=min_pages).groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("__bad")).withColumnRenamed("host", "__host")
    found = store.written(found, "boilerplate")
    if (found.agg(F.sum(F.size("__bad"))).first()[0] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    lines = F.split(text, "\n")
    clean = F.filter(lines, lambda x: ~F.array_contains(F.col("__bad"), _key(x)))
    joined = pages.withColumn("__of", host).join(found, F.col("__of").eqNullSafe(F.col("__host")), "left")
    new = F.when(F.col("__bad").isNull() | text.isNull(), text).otherwise(F.array_join(clean, "\n"))
    out = [F.col(c) if c != text_col else new.alias(c) for c in pages.columns]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        out += [F.when(text.isNull(), 0).otherwise(n).cast("long").alias(counts[0]), F.when(F.col("__bad").isNull() | text.isNull(), 0).otherwise(n - F.size(clean)).cast("long").alias(counts[1])]
    return joined.select(*out)


def with_lengths(pages: DataFrame, like: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``pages`` with the characters of its texts counted anew, if ``like`` has such a column."""
    if length_col not in like.columns:
        return pages
    return pages.withColumn(length_col, F.length(text_col).cast(like.schema[length_col].dataType))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2
), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1
), bad AS (
  SELECT c.source, c.line FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 2 AND n > pages * 0.05
), m AS (
  SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line
)
SELECT d.doc_id, CAST(coalesce(any_value(x.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(any_value(x.g), 0) AS BIGINT) AS n_dropped,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE md5(coalesce(any_value(x.t), '')) END AS kept_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM m GROUP BY 1
) x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""
