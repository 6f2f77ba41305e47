"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors have a cosine of ``c`` if their squared distance is ``2 - 2c``.  Vectors are rotated (principal
axes of a bounded sample, dealt out over the blocks in turn) and split into low-dimensional blocks; every block
gets a share of the squared distance in proportion to its variance.  A pair within the whole budget is within
its share in one block at least, so the union of the blocks' range joins holds every pair; each pair that a
block finds is verified exactly, in double precision, and counts in the first block that it is within.

A block's range join deals vectors to the nearest of some pivots of the sample.  A vector also visits every
cell beyond whose bisecting plane it lies by the block's radius at the most, so two vectors within the radius
meet.  Cells are cut into tiles of at most ``tile`` vectors; a tile returns one number of links a vector and a
spanning forest, never its pairs.

The sample (``most_sample`` vectors by hash) only steers how much work is done; results don't depend on it.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
and so do rows without an id (component null, kept); vectors of different lengths don't link; equal vectors
are one class of which each copy counts as a link; repeated rows are vectors of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store, workers

BLOCK_DIMENSIONS = 16
MOST_PIVOTS = 4096
_SLICE = 1 << 16
_SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, without overflow on the way."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class Plan:
    """Rotation, blocks with their budgets, and each block's pivots."""

    def __init__(self, sample: np.ndarray, cosine: float, pivots: int):
        d = sample.shape[1]
        self.cosine, self.n = cosine, max(1, round(d / BLOCK_DIMENSIONS))
        values, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample.T)) if len(sample) > 1 else np.eye(d))
        order = np.argsort(-values, kind="stable")
        self.axes = axes[:, order]
        self.parts = [np.arange(i, d, self.n) for i in range(self.n)]
        share = np.array([max(values[order][p].sum(), 0) + 1e-9 * len(p) for p in self.parts])
        self.budgets = share / share.sum() * (2 - 2 * cosine) * (1 + _SLACK) + 1e-9
        rotated = sample[:pivots] @ self.axes
        self.pivots = [np.unique(rotated[:, p], axis=0) for p in self.parts]

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, visiting rows, the cells that they visit: those before their home)."""
        x, c = rotated[:, self.parts[block]], self.pivots[block]
        far = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
        home = far.argmin(1)
        apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0))[home]
        near = far - far.min(1)[:, None] <= 2 * (np.sqrt(self.budgets[block]) + _SLACK) * apart + _SLACK
        row, cell = np.nonzero(near & (np.arange(len(c)) < home[:, None]))
        return home, row, cell


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def join_tile(plan: Plan, block: int, left: np.ndarray, right: np.ndarray | None, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, root of each vector's component) for the pairs of two sets, or within one.

    ``copies`` and both results run over the left set and then the right one.
    """
    same = right is None
    both = left if same else np.concatenate((left, right))
    rotated = both @ plan.axes
    narrow = rotated[:, plan.parts[block]].astype(np.float32)
    size = np.einsum("ij,ij->i", narrow, narrow)
    links, parent = np.zeros(len(both), np.int64), np.arange(len(both))
    first = 0 if same else len(left)
    for at in range(0, len(left), 512):
        rows = slice(at, min(at + 512, len(left)))
        start = at if same else first
        close = size[rows, None] + size[start:] - 2 * (narrow[rows] @ narrow[start:].T) <= plan.budgets[block] + 1e-4
        i, j = np.nonzero(close)
        i, j = i + at, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), _SLICE):
            a, b = i[s : s + _SLICE], j[s : s + _SLICE]
            found = np.einsum("ij,ij->i", both[a], both[b]) >= plan.cosine
            a, b = a[found], b[found]
            apart = (rotated[a] - rotated[b]) ** 2
            within = [apart[:, p].sum(1) <= limit for p, limit in zip(plan.parts[: block + 1], plan.budgets, strict=False)]
            mine = within[block] & ~np.logical_or.reduce([np.zeros(len(a), bool), *within[:block]])
            a, b = a[mine], b[mine]
            links += np.bincount(a, copies[b], len(both)).astype(np.int64) + np.bincount(b, copies[a], len(both)).astype(np.int64)
            while len(a):
                x, y = _roots(parent, a), _roots(parent, b)
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return links, _roots(parent, np.arange(len(both)))


def _found(vectors: DataFrame, d: int, cosine: float, tile: int, most_sample: int) -> DataFrame:
    """(hi, lo, n, a, b): links of classes, and edges between their smallest ids, for vectors of one length."""
    spark = vectors.sparkSession
    raw = vectors.orderBy("hi", "lo").limit(most_sample).select("v").toArrow()["v"].to_pylist()
    total = vectors.count()
    plan = Plan(unit(np.array(raw, float).reshape(-1, d)), cosine, min(MOST_PIVOTS, max(1, -(-total // tile))))

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rotated = unit(part.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)) @ plan.axes
                for block in range(plan.n):
                    home, row, cell = plan.cells(rotated, block)
                    for rows, cells, guest in ((np.arange(len(home)), home, False), (row, cell, True)):
                        if len(rows):
                            n = len(rows)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(cells.astype(np.int32)), pa.array(np.full(n, guest)), *part.take(pa.array(rows)).columns], ["block", "cell", "guest", "hi", "lo", "rep", "copies", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    plain = f"hi long, lo long, rep long, copies long, v {kind}"
    dealt = store.written(vectors.select("hi", "lo", "rep", "copies", "v").mapInArrow(deal, f"block int, cell int, guest boolean, {plain}"), "cells")
    counts = dealt.groupBy("block", "cell").agg(F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("homes"), F.sum(F.when(F.col("guest"), 1).otherwise(0)).alias("guests")).where("homes + guests > 1 AND homes > 0")
    homes, guests = (F.ceil(F.col(c) / F.lit(tile)) for c in ("homes", "guests"))
    own = F.pmod(F.col("hi"), F.when(F.col("guest"), guests).otherwise(homes))
    tag = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<long>"))
    tiles = F.when(F.col("guest"), F.transform(upto(homes), lambda i: tag("guest", i, F.col("own")))).otherwise(
        F.concat(F.transform(upto(homes), lambda j: tag("home", F.least(j, F.col("own")), F.greatest(j, F.col("own")))), F.transform(upto(guests), lambda j: tag("guest", F.col("own"), j)))
    )
    spread = dealt.join(F.broadcast(counts), ["block", "cell"]).withColumn("own", own).withColumn("tile", F.explode(tiles)).select("block", "cell", "tile", "guest", "own", "hi", "lo", "rep", "copies", "v")

    def run(group: pa.Table) -> pa.Table:
        t = group["tile"][0].as_py()
        mine, guest = group["own"].to_numpy(), group["guest"].to_numpy()
        left = (mine == t["i"]) & ~guest
        right = guest if t["kind"] == "guest" else (mine == t["j"]) & ~left
        order = np.concatenate((np.flatnonzero(left), np.flatnonzero(right)))
        group = group.take(pa.array(order))
        x = unit(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
        n = int(left.sum())
        alone = t["kind"] == "home" and t["i"] == t["j"]
        links, root = join_tile(plan, group["block"][0].as_py(), x if alone else x[:n], None if alone else x[n:], group["copies"].to_numpy())
        some = np.flatnonzero(links)
        rep = group["rep"].to_numpy()
        return pa.table({"hi": group["hi"].take(pa.array(some)), "lo": group["lo"].take(pa.array(some)), "n": pa.array(links[some]), "a": pa.array(rep[some]), "b": pa.array(rep[root[some]])})

    path = store.scratch(spark, "links")
    schema = "hi long, lo long, n long, a long, b long"
    spread.groupBy("block", "cell", "tile").applyInArrow(workers.tidy_group(run), schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def near_vectors(df: DataFrame, *, cosine: float = 0.95, tile: int = 4096, most_sample: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``df``: vec_id, n_links, component_id (the smallest id reachable over links), kept."""
    spark = df.sparkSession
    raw = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(raw), raw).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    rows = rows.withColumns({"hi": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "lo": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    keyed = store.written(rows, "vectors")
    classes = keyed.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    some = keyed.where("hi IS NOT NULL").join(classes, ["hi", "lo"]).where(F.col("vec_id") == F.col("rep")).select("hi", "lo", "rep", "copies", "v")
    heads = store.written(some.dropDuplicates(["hi", "lo"]), "heads")
    lengths = [r[0] for r in heads.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()]
    found = spark.createDataFrame([], "hi long, lo long, n long, a long, b long")
    for d in lengths:
        found = found.union(_found(heads.where(F.size("v") == d), d, cosine, tile, most_sample))
    links = found.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    labels = graph.connected_components(found.where("a <> b").select("a", "b"))
    named = classes.join(links, ["hi", "lo"], "left").join(labels, F.col("rep") == F.col("node"), "left").select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("label", "rep").alias("label")).where("n > 0")
    out = keyed.select("vec_id", "hi", "lo").join(named, ["hi", "lo"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
