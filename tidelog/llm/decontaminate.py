"""Benchmark decontamination by SimHash over item-sized windows; DataFrame functions only.

A document is contaminated by an item if some window of as many words as the item has (the whole document if
that is shorter) has a weighted Jaccard similarity of ``num / den`` or more with it, over ``k``-word shingles
weighted by how often they occur; a text of fewer words than ``k`` is one shingle.

1. Windows.  Word shingles of documents that occur in an item are looked up, and windows that can't be similar
   enough are left out without loss: those in which less than ``num * (both sizes) / (num + den)`` shingles are
   such hits, or that don't start at one (and are not the document's last).  With ``prefilter=False`` every
   window goes on.
2. Windows and items get 64-bit SimHash fingerprints.
3. Multi-index lookup.  Fingerprints are cut into :data:`BLOCKS` blocks of 16 bits.  Two within ``radius`` bits
   differ in at most ``radius // BLOCKS`` bits of some block, so each item is looked for under all values that
   close to its own, block by block: every fingerprint within the radius is found, and few others are touched
   (4.3 % of random pairs at the default radius of 15).  Their whole distance is then checked.  A pair exactly at
   a similarity of 0.8 differs in 9.7 bits on average, one at 0.9 in 6.6.
4. Candidates are verified by their exact weighted-shingle similarity.

Shingles are compared by 64-bit hashes.  Texts are looked up as classes of equal texts, so copies cost nothing.
The lookup broadcasts the items' shingles if they are at most :data:`BROADCAST_SHINGLES`, counted before, and
is a shuffled join otherwise.

Defined results: null and empty texts and items match nothing; rows without an id are reported (and dropped)
like others; repeated rows are reported each; of an item's equally similar windows (of those that start at a
hit or are the last) the first is reported; an empty table on either side gives no matches; other columns pass through :func:`drop_contaminated`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BROADCAST_SHINGLES = 1_000_000
#: Classes of texts (16 bytes each) that may be broadcast to pick texts out.
BROADCAST_TEXTS = 500_000
BLOCKS = 4
#: Items whose lookup values (2,788 each, 40 bytes) may be broadcast.
BROADCAST_ITEMS = 250
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The lower-case words of a text; null for texts without any."""
    bare = F.btrim(F.lower(text), F.lit(_SPACE))
    return F.when(bare != "", F.split(bare, "[\\x20\\x09-\\x0D]+"))


def shingles(word_list: Column, k: int) -> Column:
    """The hash of each run of ``k`` words; empty if there are fewer."""
    run = lambda w, i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    some = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: run(w, i))).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(word_list), some), 0)  # the outer lambda makes sure that words are cut once


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb")]


def _fingerprints(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """The SimHash ``fp`` of each group's hashes, each counted as often as it occurs."""
    votes = rows.groupBy(*keys).agg(F.count("*").alias("n_votes"), *[F.sum(F.shiftright(h, b).bitwiseAND(1)).alias(f"v{b}") for b in range(64)])
    bits = [F.when(F.col(f"v{b}") * 2 > F.col("n_votes"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return votes.select(*keys, fp.alias("fp"))


def near_values(bits: int, distance: int) -> list[int]:
    """What a value of ``bits`` bits is combined with by exclusive or to give all values within ``distance``."""
    return [sum(1 << b for b in some) for n in range(distance + 1) for some in combinations(range(bits), n)]


def _blocks(fp: str, distance: int = 0) -> Column:
    """(block, value) of each block, with all values within ``distance`` bits."""
    width = 64 // BLOCKS
    out = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, width * i).bitwiseAND((1 << width) - 1).cast("int").alias("value")) for i in range(BLOCKS)]
    if not distance:
        return F.explode(F.array(*out))
    near = F.split(F.lit(",".join(map(str, near_values(width, distance)))), ",").cast("array<int>")  # one constant for the optimizer
    return F.explode(F.flatten(F.transform(F.array(*out), lambda b: F.transform(near, lambda x: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(x).alias("value"))))))


def find(docs: DataFrame, items: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, radius: int = 15, prefilter: bool = True, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(ta, tb, item_id, start, n_words, n_common, n_union, similarity): matches of classes of equal texts.

    ``ta``, ``tb`` are two hashes of the text; ``start`` is the best window's first word, counted from 0.
    """
    cut = store.written(items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).where("w IS NOT NULL AND item_id IS NOT NULL").withColumn("size", F.size("w")).withColumn("k", F.least("size", F.lit(k))).distinct(), "items")
    out = None
    for width in sorted(r[0] for r in cut.select("k").distinct().collect()) or [k]:
        own = store.written(cut.where(F.col("k") == width).select("item_id", "size", F.posexplode(shingles(F.col("w"), width)).alias("at", "h")), "item-shingles")
        part = _matches(docs, own, width, num, den, radius, prefilter, text_col)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("n_common", (-F.col("start")).alias("start"), "n_words", "n_union")).alias("m")
    best = out.groupBy("ta", "tb", "item_id").agg(best)
    return best.select("ta", "tb", "item_id", (-F.col("m.start")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"), "m.n_common", "m.n_union", (F.col("m.n_common") / F.col("m.n_union")).alias("similarity"))


def _matches(docs: DataFrame, items: DataFrame, k: int, num: int, den: int, radius: int, prefilter: bool, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    known = items.select("h", "size").distinct()
    if items.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    listed = docs.select(*_key(text), words(text).alias("w")).where("w IS NOT NULL")
    placed = listed.select("ta", "tb", F.size("w").alias("m"), F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))
    if prefilter:
        hits = placed.join(known, "h").groupBy("ta", "tb", "m", "size").agg(F.collect_set("at").alias("places"))
        hits = store.written(hits.withColumn("places", F.array_sort("places")), "hits")
    else:
        sizes = sorted(r[0] for r in items.select("size").distinct().collect())
        hits = listed.select("ta", "tb", F.size("w").alias("m"), F.explode(F.lit(sizes)).alias("size")).where(F.col("m") >= k).distinct()

    # Windows: where they start, and how many shingles they have.
    whole = F.col("size") - k + 1
    wide = F.least(whole, F.col("m") - k + 1)
    need = F.floor((num * (whole + wide) + num + den - 1) / F.lit(num + den)).cast("int")
    last = F.greatest(F.col("m") - F.col("size"), F.lit(0))
    sized = hits.withColumns({"wide": wide, "need": need, "last": last})
    full = lambda i: (F.get("places", i) <= F.col("last")) & (F.get("places", i + F.col("need") - 1) < F.get("places", i) + F.col("wide"))
    begun = F.transform(F.filter(F.sequence(F.lit(0), F.size("places") - 1), full), lambda i: F.get("places", i))
    end = F.when(F.size(F.filter("places", lambda p: p >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = F.array_union(begun, end) if prefilter else F.sequence(F.lit(0), "last")
    windows = store.written(sized.select("ta", "tb", "size", "wide", F.explode(starts).alias("start")), "windows")

    chosen = windows.select("ta", "tb").distinct()
    if chosen.count() <= BROADCAST_TEXTS:
        chosen = F.broadcast(chosen)
    texts = docs.select(*_key(text), text.alias("t")).join(chosen, ["ta", "tb"], "left_semi").dropDuplicates(["ta", "tb"])
    listed = store.written(texts.select("ta", "tb", shingles(words(F.col("t")), k).alias("hs")), "listed")
    key = ["ta", "tb", "size", "wide", "start"]
    held = windows.join(listed, ["ta", "tb"]).select(*key, F.explode(F.slice("hs", F.col("start") + 1, F.col("wide"))).alias("h"))
    weighted = store.written(held.groupBy(*key, "h").agg(F.count("*").alias("n")), "window-shingles")

    # Candidates by fingerprint.
    prints = _fingerprints(held, key, "h")
    item_prints = store.written(_fingerprints(items.select("item_id", "size", "h"), ["item_id", "size"], "h"), "item-fingerprints")
    left = prints.select(*key, "fp", _blocks("fp").alias("b")).select(*key, "fp", "b.block", "b.value")
    right = item_prints.select("item_id", "size", F.col("fp").alias("item_fp"), _blocks("fp", radius // BLOCKS).alias("b")).select("item_id", "size", "item_fp", "b.block", "b.value")
    if item_prints.count() <= BROADCAST_ITEMS:
        right = F.broadcast(right)
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    candidates = near.select(*key, "item_id").distinct()

    # Verification.
    counted = items.groupBy("item_id", "h").agg(F.count("*").alias("n_item"))
    common = candidates.join(weighted, key).join(counted, ["item_id", "h"]).groupBy(*key, "item_id").agg(F.sum(F.least("n", "n_item")).alias("n_common"))
    sums = common.withColumn("n_union", F.col("size") - k + 1 + F.col("wide") - F.col("n_common"))
    return sums.where(F.col("n_common") * den >= F.col("n_union") * num).select("ta", "tb", "item_id", "start", (F.col("wide") + k - 1).alias("n_words"), "n_common", F.col("n_union").cast("long").alias("n_union"))


def contaminations(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` and item that contaminates it: doc_id and the columns of :func:`find`."""
    found = store.written(find(docs, items, text_col=text_col, **options), "contaminations")
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_key(F.col(text_col).cast("string")))
    return keyed.join(found, ["ta", "tb"]).select("doc_id", "item_id", "start", "n_words", "n_common", "n_union", "similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they were."""
    found = store.written(find(docs, items, text_col=text_col, **options).select(F.col("ta").alias("__ta"), F.col("tb").alias("__tb")).distinct(), "contaminated")
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    a, b = _key(F.col(text_col).cast("string"))
    return docs.join(found, (a == F.col("__ta")) & (b == F.col("__tb")) & F.col(text_col).isNotNull(), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, len(w) AS m, p AS pos, list_aggregate(w[p + 1 : p + 5], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
), ish AS (
  SELECT item_id, len(w) AS size, list_aggregate(w[p + 1 : p + 5], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 5)
), n AS (SELECT item_id, size, s, count(*) AS n_item FROM ish GROUP BY 1, 2, 3
), hit AS (
  SELECT doc_id, m, item_id, size, pos, least(size, m) - 4 AS wide FROM ds JOIN n USING (s)
), start AS (
  SELECT DISTINCT doc_id, item_id, size, wide, least(pos, greatest(m - size, 0)) AS first FROM hit
), common AS (
  SELECT doc_id, item_id, size, wide, first, sum(least(n_doc, n_item)) AS n_common FROM (
    SELECT t.doc_id, t.item_id, t.size, t.wide, t.first, ds.s, count(*) AS n_doc
    FROM start t JOIN ds ON ds.doc_id = t.doc_id AND ds.pos BETWEEN t.first AND t.first + t.wide - 1 GROUP BY ALL
  ) JOIN n USING (item_id, size, s) GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_common DESC, first) AS r FROM common
  WHERE n_common * 100 >= (size - 4 + wide - n_common) * 80
)
SELECT doc_id, item_id, CAST(first AS BIGINT) AS start, CAST(wide + 4 AS BIGINT) AS n_words, CAST(n_common AS BIGINT) AS n_common,
       CAST(size - 4 + wide - n_common AS BIGINT) AS n_union, n_common / (size - 4 + wide - n_common) AS similarity
FROM best WHERE r = 1
"""
