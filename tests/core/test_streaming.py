import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import nodes
from tidelog.operators.nodes import DIFF
from tidelog.plans.flow import batch_of
from tidelog.sources import logs
from tidelog.streaming import micro

SCHEMA = f"k string, v double, __t0 long, {DIFF} long"


def batches(seed):
    r, out = random.Random(seed), []
    for b in range(3):
        out.append([(r.choice("abc"), float(r.randrange(5)), 2 * b + r.randrange(2), r.choice([1, 1, -1])) for _ in range(12)] + [("z", 0.0, 2 * b + 1, 1)])
    return out


def feed(spark, tmp_path, name, parts):
    path = str(tmp_path / name)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def finish(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_gives_the_batch_result(spark, tmp_path):
    parts = batches(1)
    build = lambda x: x.reduce(1, nodes.total("v"), nodes.count())
    stream = feed(spark, tmp_path, "in", parts)
    finish(micro.run(stream, build, str(tmp_path / "log"), str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    rows = [(r[:2], (r[2],), r[3]) for p in parts for r in p]
    want = [c for c in batch_of(build(logs.from_changes(spark, rows, "k string, v double")).changes()) if c[1] < (5,)]
    assert batch_of(micro.closed_changes(spark, str(tmp_path / "sink"))) == want


def test_late_data_stops_the_stream(spark, tmp_path):
    stream = feed(spark, tmp_path, "late", [[("a", 1.0, 5, 1)], [("a", 1.0, 1, 1)]])
    query = micro.run(stream, lambda x: x.distinct(), str(tmp_path / "log"), str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "cp")).start()
    with pytest.raises(Exception, match="late data"):
        finish(query)


def test_streaming_join_equals_batch_join(spark, tmp_path):
    a, b = batches(2), batches(3)
    out = micro.join(feed(spark, tmp_path, "a", a), feed(spark, tmp_path, "b", b).withColumnRenamed("v", "w"), ["k"])
    finish(out.writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "cp")).start())
    one, two = ([(r[:2], (r[2],), r[3]) for p in parts for r in p] for parts in (a, b))
    want = batch_of(logs.from_changes(spark, one, "k string, v double").join(logs.from_changes(spark, two, "k string, w double"), 1).changes())
    got = spark.table("joined").groupBy("k", "v", "w", "__t0").agg(F.sum(DIFF).alias(DIFF)).where(f"{DIFF} <> 0")
    assert batch_of(got) == want


def test_running_sums_equal_the_batch_reduce(spark, tmp_path):
    parts = batches(4)
    stream = feed(spark, tmp_path, "in", parts).withColumn("v", F.col("v").cast("long"))
    finish(micro.running_sums(stream, "k", "v").writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = spark.table("sums").groupBy("k", "sum", "__t0").agg(F.sum(DIFF).alias(DIFF)).where(f"{DIFF} <> 0")
    rows = [((k, int(v)), (t,), d) for p in parts for k, v, t, d in p]
    want = logs.from_changes(spark, rows, "k string, v long").reduce(1, nodes.total("v", "sum"), empty_groups="drop").changes()
    assert dict(got.dtypes)["sum"] == "bigint"
    assert batch_of(got) == batch_of(want.select("k", "sum", "__t0", DIFF))
