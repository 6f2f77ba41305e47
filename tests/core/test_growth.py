"""What keeps time and a task's memory in bounds on larger tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidelog.operators import nodes
from tidelog.sources import logs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_range_join_are_not_added_up(spark):
    points = logs.from_changes(spark, [((k, s), (0,), d) for k, s, d in [(1, 3, 1), (2, 7, 2), (3, None, 1), (4, 3, 1), (4, 3, -1), (2, 7, 1)]], "k long, s long")
    bands = logs.from_changes(spark, [((b, lo, hi), (0,), d) for b, lo, hi, d in [(1, 0, 9, 1), (2, 3, 3, 1), (3, 6, 30, 2), (1, 0, 9, 1), (4, 9, 2, 1)]], "b long, lo long, hi long")
    out = points.range_join(bands, "s", "lo", "hi", 5).as_of(0)
    got = Counter({tuple(r[:-1]): r[-1] for r in out.collect()})
    assert got == Counter({(1, 3, 1, 0, 9): 2, (1, 3, 2, 3, 3): 1, (2, 7, 1, 0, 9): 6, (2, 7, 3, 6, 30): 6}) and out.count() == 4
    assert "Aggregate" not in plan(out).split("Join")[0]


def test_keys_of_other_types_are_still_added_up(spark):
    left = logs.from_changes(spark, [((2.0**53, "a"), (0,), 1)], "k double, v string")
    right = logs.from_changes(spark, [((2**53, "x"), (0,), 1), ((2**53 + 1, "x"), (0,), 1)], "k long, w string")
    assert [tuple(r) for r in left.join(right, 1).as_of(0).collect()] == [(2.0**53, "a", "x", 2)]


def stored(spark, rows, path):
    """A log in a file, whose size is known."""
    logs.from_changes(spark, rows, "k long, v string").log.write.parquet(str(path))
    return nodes.Input(spark.read.parquet(str(path)))


def random_rows(seed, n=120, keys=3):
    r = random.Random(seed)
    return [((r.randrange(keys), r.choice("abc")), (r.randrange(4),), r.choice([1, 1, -1])) for _ in range(n)]


def test_keys_of_large_joins_are_dealt_over_parts_by_size(spark, monkeypatch, tmp_path):
    rows, others = random_rows(1), random_rows(2, keys=4)
    x, y = stored(spark, rows, tmp_path / "x"), stored(spark, others, tmp_path / "y")
    want = Counter()
    for (k, v), (t,), d in rows:
        for (j, w), (u,), e in others:
            if k == j:
                want[k, v, w, max(t, u)] += d * e
    for small, share in ((1 << 24, 1 << 22), (0, 256)):
        monkeypatch.setattr(nodes, "SMALL", small)
        monkeypatch.setattr(nodes, "SHARE", share)
        out = x.join(y, 1).changes()
        assert {tuple(r[:4]): r[4] for r in out.collect()} == {k: n for k, n in want.items() if n}
        assert ("RepartitionByExpression" in plan(out)) == (small == 0)


def first_rows(rows, n, keys):
    out, before = Counter(), {}
    for t in range(4):
        live = Counter()
        for row, (u,), d in rows:
            live[row] += d * (u <= t)
        by = {}
        for k, v in sorted((r for r, d in live.items() if d), key=lambda r: (-ord(r[1]), r)):
            by.setdefault(k if keys else None, []).append((k, v))
        now = {r for found in by.values() for r in found[:n]}
        for r in now ^ set(before):
            out[(*r, t)] += 1 if r in now else -1
        before = now
    return out


def test_the_first_rows_of_parts_compete(spark, monkeypatch, tmp_path):
    for seed in range(2):
        rows = [*random_rows(seed, 60), *[((9, v), (t,), d) for v, t, d in [("a", 0, 1), ("b", 1, 1), ("a", 1, -1), ("b", 3, -1)]]]
        x = stored(spark, rows, tmp_path / str(seed))
        for share in (1 << 22, 256):
            monkeypatch.setattr(nodes, "SHARE", share)
            for n, keys in ((1, 1), (2, 1), (3, 0)):
                out = x.top(keys, n, F.desc("v")).changes()
                assert Counter({tuple(r[:3]): r[3] for r in out.collect()}) == first_rows(rows, n, keys)
                assert ("__part" in plan(out)) == (share == 256) and "Join" not in plan(out)
