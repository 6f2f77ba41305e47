"""Change logs from tables and files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nodes import DIFF, Collection, Input

SYSTEM = ("parquet", "orc", "json", "csv")


def from_table(df: DataFrame, rows: list[str | Column] | None = None, *, time: Column | str | int = 0, diff: Column | str | int = 1) -> Input:
    """A collection at one input time coordinate; ``time`` and ``diff`` are expressions over ``df``."""
    expression = lambda x: F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x
    columns = [F.col(c) if isinstance(c, str) else c for c in rows] if rows else [F.col(c) for c in df.columns]
    return Input(df.select(*columns, expression(time).cast("long").alias("__t0"), expression(diff).cast("long").alias(DIFF)), depth=1)


def from_changes(spark: SparkSession, changes: list[tuple], schema: str, depth: int = 1) -> Input:
    """A collection from literal changes ``(row, time, diff)``."""
    names = [f.strip() for f in schema.split(",")]
    times = "".join(f", __t{i} long" for i in range(depth))
    return Input(spark.createDataFrame([(*row, *t, d) for row, t, d in changes], f"{', '.join(names)}{times}, {DIFF} long"), depth=depth)


def read(spark: SparkSession, path: str, kind: str = "parquet", *, schema: str | None = None, **spec) -> Input:
    """:func:`from_table` over a file that Spark reads."""
    reader = spark.read.format(kind)
    return from_table((reader.schema(schema) if schema else reader).load(path), **spec)


def write(collection: Collection, path: str, kind: str = "parquet", *, mode: str = "errorifexists") -> None:
    """The coalesced changes as a file; :func:`read_log` reads them back."""
    collection.changes().write.format(kind).mode(mode).save(path)


def read_log(spark: SparkSession, path: str, kind: str = "parquet") -> Input:
    df = spark.read.format(kind).load(path)
    return Input(df, depth=sum(c.startswith("__t") for c in df.columns))
