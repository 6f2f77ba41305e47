"""Dataflows over Structured Streaming.

:func:`run` feeds micro-batches to a collection's log: each batch is written to a change table in the shared
store, the input's frontier moves to the times that the batch closes, and the output's newly closed changes are
appended to a sink table under the batch's number, so that a batch that is run again replaces its own rows.

:func:`running_sums` keeps sums per key as streaming state and emits insertions and retractions; :func:`join`
joins two change streams, as bilinear operators need no state but the logs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.times import bound_columns, coordinates
from ..operators.nodes import DIFF, Collection, Input


def as_changes(stream: DataFrame, rows: list[str | Column], *, time: Column, diff: Column | int = 1) -> DataFrame:
    """A stream of changes (rows, ``__t0``, ``__diff``) from a stream of records."""
    diff = F.lit(diff) if isinstance(diff, int) else diff
    return stream.select(*rows, time.cast("long").alias("__t0"), diff.cast("long").alias(DIFF))


def run(changes: DataFrame, build: Callable[[Collection], Collection], log_path: str, sink_path: str) -> DataStreamWriter:
    """A writer (to be started with a checkpoint location) that keeps ``build(input)``'s closed changes in a table.

    A time is closed when a later one has come; a batch with an earlier time than what is closed fails, as a
    frontier is a promise.  ``sink_path`` is partitioned by batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.withColumn("__batch", F.lit(number).cast("long")).persist()
        try:
            first = df.agg(F.min("__t0")).first()[0]
            if first is None:
                return
            before = _read(spark, log_path, df.schema)
            closed = before.where(F.col("__batch") < number).agg(F.max("__t0")).first()[0] if before is not None else None
            if closed is not None and first < closed:
                raise ValueError(f"late data: {first} is before the frontier {closed}")
            _replace(df, log_path)
        finally:
            df.unpersist()
        log = _read(spark, log_path, df.schema).where(F.col("__batch") <= number)
        upto = log.agg(F.max("__t0")).first()[0]
        out = build(Input(log.drop("__batch"))).changes()
        since = out if closed is None else out.where(F.col("__t0") >= closed)
        _replace(since.where(F.col("__t0") < upto).withColumn("__batch", F.lit(number).cast("long")), sink_path)

    return changes.writeStream.foreachBatch(batch)


def _replace(df: DataFrame, path: str) -> None:
    """Write one batch's partition in the place of what an earlier attempt has left."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(path)


def _read(spark, path: str, schema) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).parquet(path)


def closed_changes(spark, sink_path: str) -> DataFrame:
    """What :func:`run` has found so far."""
    return spark.read.parquet(sink_path).drop("__batch")


def join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two change streams: least upper bounds of times, products of diffs.  Inner, append mode."""
    times = [c for c in left.columns if c in coordinates(len(left.columns))]
    rest = [c for c in right.columns if c not in {*keys, *times, DIFF}]
    own = left.select(*[F.col(c).alias(f"__l{c}" if c in {*times, DIFF} else c) for c in left.columns])
    other = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *rest, *[F.col(c).alias(f"__r{c}") for c in [*times, DIFF]])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    columns = [c for c in left.columns if c not in {*times, DIFF}]
    return own.join(other, on).select(*columns, *rest, *bound_columns(len(times), "__l", "__r"), (F.col(f"__l{DIFF}") * F.col(f"__r{DIFF}")).alias(DIFF))


def running_sums(changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sum, __t0, __diff): at each time of a key's changes, the old sum retracted and the new inserted.

    State is the sum, the live count and the last time of each key; a key whose count is zero has no row.  Sums
    of integers are exact longs, others doubles.  A change before its key's last time of an earlier batch raises.
    """
    kind = changes.schema[key].dataType.simpleString()
    number = "long" if changes.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    zero = int if number == "long" else float

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, live, last = state.get if state.exists else (zero(0), 0, None)
        by_time: dict[int, list] = {}
        for f in frames:
            for v, t, d in zip(f[value].tolist(), f["__t0"].tolist(), f[DIFF].tolist(), strict=True):
                own = by_time.setdefault(int(t), [zero(0), 0])
                own[0], own[1] = own[0] + (zero(v) * int(d) if v == v and v is not None else 0), own[1] + int(d)
        rows = []
        for t in sorted(by_time):
            if last is not None and t < last:
                raise ValueError(f"late data: {t} is before {last}")
            before, had = total, live != 0
            total, live, last = total + by_time[t][0], live + by_time[t][1], t
            if had and live != 0 and before == total:
                continue
            rows += [(k[0], before, t, -1)] * had + [(k[0], total, t, 1)] * (live != 0)
        state.update((total, live, last))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "sum", "__t0", DIFF])

    return changes.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, sum {number}, __t0 long, {DIFF} long", f"sum {number}, live long, last long", "append", "NoTimeout")
