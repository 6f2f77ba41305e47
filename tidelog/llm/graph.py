"""Connected components over an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _with_least(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b) with ``m``, the least b of their a.

    A node's rows are dealt by part as well, the part being a hash of b, so no task holds a hub: minima of parts are
    as many as there are shuffle partitions at the most, and go back to those parts of the node that exist.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).repartition("a", "part")
    least = dealt.groupBy("a", "part").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    back = least.select("a", "m", F.explode("parts").alias("part"))
    return dealt.join(back, ["a", "part"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(edges.select(F.explode(ways).alias("way")).select("way.a", "way.b"))
    return met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    met = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    return met.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))  # the row of the least b links the node itself


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); the label is the component's smallest node.

    Alternating large-star and small-star rounds, in which a node with very many neighbours is dealt over all
    partitions.  Every round ends in ``checkpoint()``, after which the driver's garbage is collected: what it keeps
    of a round grows with the partitions, and the round's shuffle files go with it.  Edges with a null end and loops
    are left out.
    """
    now = store.cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(now)
    if before[0]:
        for _ in range(max_rounds):
            now = store.cut(_small_star(_large_star(now)).distinct())
            after = state(now)
            store.let_go(now.sparkSession)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
