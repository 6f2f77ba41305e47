"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit circle give the whole signature: sigma scatters the shingles (the upper half of
a 64-bit avalanche hash), pi (another bijection) is used shifted around the circle, coordinate j being the
minimum of pi(sigma(s) + j * step).  Bands of ``rows`` coordinates become bucket keys; there are as many bands
as it takes to miss a pair at the threshold with a probability of ``miss`` at most.

What is done with the buckets is exact and never emits a group's pairs:

1. Documents with the same shingle set are one class, named by its smallest id.
2. Star round: each bucket's members meet one centre, which differs from band to band.  Sizes that rule a
   link out drop a pair; the rest is verified on full sets.  Verified links are contracted to components.
3. Buckets that still hold several components are settled by tiles of about ``tile`` members (fewer long ones): those outside
   the bucket's largest component meet all others, and a tile returns at most a spanning forest.  No pair of a
   bucket that could join two components is left out, whatever the bucket's size.

Defined results: a null or empty text has no shingles and links with nothing; a text with fewer than ``k``
words is one shingle; repeated rows are exact copies; a row without an id takes the component of its text (or
null) and is kept if that is null; classes whose smallest id is the same are one node; other columns of the
input pass through :func:`deduplicate` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store, workers
from .words import mix, pieces, shingle_sets

_STEP = 0x9E3779B1
#: Ids that a broadcast may hold (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles that a tile holds on average at the most (or two documents).
TILE_SHINGLES = 1_000_000


def bands_for(threshold: float, rows: int = 5, miss: float = 1e-6) -> int:
    """Bands with which a pair at ``threshold`` shares no bucket with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a shingle set."""
    sigma = (shingles >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None] * np.uint32(_STEP)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 2048):
        x = sigma[None, at : at + 2048] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key a band; the band's number is part of it."""
    table = sig.reshape(-1, rows).astype(np.uint64)
    key = mix(np.arange(1, len(table) + 1, dtype=np.uint64))
    for i in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + table[:, i])
    return key.view(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of rows with about 1 MB of text, as UTF-8."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    for s, e in pieces([len(t) if t else 0 for t in texts], 1 << 20):
        yield s, e, texts[s:e]


def _features(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, bands): ``hi``, ``lo`` are a 128-bit digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in _texts(batch, 1):
                n, hi, lo, keys = [], [], [], []
                for shingles in shingle_sets(texts, k):
                    n.append(len(shingles))
                    if len(shingles):
                        a, b = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist()
                        keys.append(band_keys(signature(shingles, rows * bands), rows))
                    else:
                        a = b = None
                        keys.append(None)
                    hi.append(a)
                    lo.append(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "hi", "lo", "bands"])

    return docs.mapInArrow(workers.tidy(run), "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the full shingle sets, 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in _texts(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array([x.tobytes() for x in shingle_sets(texts, k)], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(workers.tidy(run), "node long, shingles binary")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of ``num / den`` at least."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(workers.tidy(run), "a long, b long")


def tile_forest(nodes: list[int], labels: list[int], minor: list[bool], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components of a tile, as few as connect all that are connected.

    All pairs of which one side is ``minor`` are looked at unless their components have met already.
    """
    parent: dict[int, int] = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, where = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    order = np.argsort(where, kind="stable")
    by_value, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(values)))))
    own = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in np.flatnonzero(minor).tolist():
        s, e = first[where[own[i] : own[i + 1]]], first[where[own[i] : own[i + 1]] + 1]
        if not len(s):
            continue
        lengths = e - s
        flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(s, lengths)
        both = np.bincount(by_value[flat], minlength=len(sets))
        for j in np.flatnonzero(den * both >= num * (sizes[i] + sizes - both)).tolist():
            if j != i and both[j] and (a := root(labels[i])) != (b := root(labels[j])):
                parent[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def _settled(live: DataFrame, comp: DataFrame, sets: DataFrame, num: int, den: int, tile: int) -> DataFrame | None:
    """Links that join components within a bucket (step 3); None if no bucket has two."""
    members = live.join(comp, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    load = F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(TILE_SHINGLES / tile)))).cast("long")  # a long member counts as several
    counts = members.groupBy("key", "label").agg(load.alias("load"))
    buckets = counts.groupBy("key").agg(F.max_by("label", F.struct("load", "label")).alias("major"), F.max("load").alias("l_major"), F.sum("load").alias("l_all"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda load: F.ceil(load / F.lit(tile // 2)).cast("long")
    open_ = store.cut(members.join(buckets, "key").select("key", "node", "label", (F.col("label") != F.col("major")).alias("minor"), parts(F.col("l_major")).alias("p_major"), parts(F.col("l_all") - F.col("l_major")).alias("p_minor")))
    if open_.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("p_minor")).otherwise(F.col("p_major")))
    small = F.sequence(F.lit(0).cast("long"), F.col("p_minor") - 1)
    large = F.sequence(F.lit(0).cast("long"), F.col("p_major") - 1)
    tag = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    tiles = F.when(
        F.col("minor"), F.concat(F.transform(small, lambda j: tag("m", F.least(j, F.col("own")), F.greatest(j, F.col("own")))), F.transform(large, lambda j: tag("M", F.col("own"), j)))
    ).otherwise(F.transform(small, lambda i: tag("M", i, F.col("own"))))
    dealt = open_.withColumn("own", own).select("key", "node", "label", "minor", F.explode(tiles).alias("tile")).join(sets, "node").select("key", "tile", "node", "label", "minor", "shingles")

    def run(group: pa.Table) -> pa.Table:
        found = tile_forest(group["node"].to_pylist(), group["label"].to_pylist(), group["minor"].to_pylist(), [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.groupBy("key", "tile").applyInArrow(workers.tidy_group(run), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, rows: int = 5, miss: float = 1e-6, tile: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Links join documents whose ``k``-word shingle sets have a Jaccard similarity of ``num / den`` or more.
    """
    workers.small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = store.written(_features(plain, k, rows, bands_for(num / den, rows, miss)), "minhash")
    classes = features.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.count("doc_id").alias("named")).where("named > 0")
    heads = features.join(classes.select("hi", "lo", F.col("rep").alias("doc_id")), ["hi", "lo", "doc_id"], "left_semi")
    entries = heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("centre"), F.min_by("n", F.xxhash64("key", "node")).alias("n_centre"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "centre", "n_centre")
    live = store.written(entries.join(buckets, "key").select("key", "node", "n", "centre", "n_centre").distinct(), "buckets")
    wanted = live.select("node").distinct()
    if live.select("node").distinct().count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = store.written(_sets(plain.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text"), k), "sets")
    fits = (den * F.least("n", "n_centre") >= num * F.greatest("n", "n_centre")) & (F.col("node") != F.col("centre"))
    stars = live.where(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    comp = graph.connected_components(_verified(stars, sets, num, den))
    more = _settled(live.select("key", "node", "n"), comp, sets, num, den, tile)
    if more is not None:
        comp = graph.connected_components(more.union(comp.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("hi", "lo", "copies", F.coalesce("label", "rep").alias("component_id"), "rep").where("copies > 1 OR component_id <> rep").select("hi", "lo", "component_id")
    joined = features.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one document, all columns as they were.

    The document kept is the one with the group's smallest id.  Of rows that repeat an id and its text one stays;
    rows that share an id but not the text are judged as one node and stay or go together; rows without an id all stay, as nothing can name them.
    """
    key = F.col(options.get("id_col", "doc_id")).cast("long")
    gone = near_duplicates(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.withColumn("__id", key).join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    if docs.select(key.alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept.drop("__id")
    text = F.col(options.get("text_col", "text")).cast("string")
    keyed = kept.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})
    return keyed.where("__id IS NOT NULL").dropDuplicates(["__id", "__h1", "__h2"]).union(keyed.where("__id IS NULL")).drop("__id", "__h1", "__h2")
