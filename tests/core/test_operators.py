import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.functions.times import Order, causal
from tidelog.operators import nodes
from tidelog.operators.nodes import DIFF, Moments, PlanError
from tidelog.plans.flow import batch_of
from tidelog.sources import logs


def log(spark, changes, schema="k string, v double", depth=1):
    return logs.from_changes(spark, changes, schema, depth)


def bag(changes, at):
    out = Counter()
    for row, t, d in changes:
        if causal(t, at) in (Order.LT, Order.EQ):
            out[row] += d
    return {r: n for r, n in out.items() if n}


def all_times(depth, n=4):
    return list(itertools.product(range(n), repeat=depth))


def check_law(node, want, depth):
    """Changes add up to the batch result at every time; both ways of evaluation agree with ``want(time)``."""
    changes = batch_of(node.changes(), depth)
    assert all(d for *_, d in changes) and len({c[:2] for c in changes}) == len(changes)
    spark = node._changes().sparkSession
    times = all_times(depth)
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(times)], "__at long" + "".join(f", __b{i} long" for i in range(depth)))
    many = defaultdict(dict)
    for r in node.at(Moments(frame=frame)).collect():
        many[times[r["__at"]]][tuple(r[c] for c in node.columns)] = r[DIFF]
    for t in times:
        assert bag(changes, t) == want(t), t
        assert many.get(t, {}) == want(t), t
    single = {tuple(r[c] for c in node.columns): r[DIFF] for r in node.as_of(*times[-2]).collect()}
    assert single == want(times[-2])


def random_log(seed, depth, low=-2, n=40):
    r = random.Random(seed)
    return [((r.choice("ab") * r.randint(1, 2), float(r.randrange(3))), tuple(r.randrange(3) for _ in range(depth)), r.choice([x for x in range(low, 3) if x])) for _ in range(n)]


@pytest.mark.parametrize("depth", [1, 2])
def test_law_of_linear_operators_and_join(spark, depth):
    a, b = random_log(1, depth), random_log(2, depth)
    x, y = log(spark, a, depth=depth), log(spark, b, depth=depth)
    check_law(x.project(0), lambda t: {k: n for k, n in sum_by(bag(a, t), lambda r: (r[0],)).items() if n}, depth)
    check_law(x.filter("v > 0"), lambda t: {r: n for r, n in bag(a, t).items() if r[1] > 0}, depth)
    check_law(x.union(y), lambda t: bag(a + b, t), depth)
    check_law(x.map_rows(lambda r: (r[0] + "!",), "k string"), lambda t: {r: n for r, n in sum_by(bag(a, t), lambda r: (r[0] + "!",)).items() if n}, depth)
    joined = lambda t: {r: n for r, n in join_bags(bag(a, t), bag(b, t), 1).items() if n}
    check_law(x.join(y, 1), joined, depth)
    check_law(x.index().join(y.index(), 1), joined, depth)
    check_law(x.join(y, 0), lambda t: {r: n for r, n in join_bags(bag(a, t), bag(b, t), 0).items() if n}, depth)


def sum_by(b, key):
    out = Counter()
    for r, n in b.items():
        out[key(r)] += n
    return out


def join_bags(a, b, k):
    out = Counter()
    for (r, n), (s, m) in itertools.product(a.items(), b.items()):
        if r[:k] == s[:k]:
            out[r + s[k:]] += n * m
    return out


@pytest.mark.parametrize("depth", [1, 2])
def test_law_of_distinct_and_sets(spark, depth):
    a, b = random_log(3, depth), random_log(4, depth)
    x, y = log(spark, a, depth=depth), log(spark, b, depth=depth)
    check_law(x.distinct(), lambda t: dict.fromkeys(bag(a, t), 1), depth)
    check_law(x.intersect(y), lambda t: dict.fromkeys(set(bag(a, t)) & set(bag(b, t)), 1), depth)
    check_law(x.difference(y), lambda t: dict.fromkeys(set(bag(a, t)) - set(bag(b, t)), 1), depth)
    keys = lambda t: {r[0] for r in bag(b, t)}
    some = lambda t: {r[0] for r in sum_by(bag(b, t), lambda r: (r[0],)).items() if r[1]} if False else {k[0] for k, n in sum_by(bag(b, t), lambda r: (r[0],)).items() if n}
    del keys
    check_law(x.semi_join(y), lambda t: {r: n for r, n in bag(a, t).items() if r[0] in some(t)}, depth)
    check_law(x.anti_join(y), lambda t: {r: n for r, n in bag(a, t).items() if r[0] not in some(t)}, depth)


def seen(changes, at, key):
    """Keys that have had a change, after changes at one time are added up."""
    out = Counter()
    for row, t, d in changes:
        out[row, t] += d
    return {key(r) for (r, t), n in out.items() if n and causal(t, at) in (Order.LT, Order.EQ)}


@pytest.mark.parametrize("depth", [1, 2])
@pytest.mark.parametrize("k", [1, 0])
def test_law_of_sums(spark, depth, k):
    a = random_log(5, depth)
    x = log(spark, a, depth=depth)

    def want(t):
        out = {}
        for key in seen(a, t, lambda r: r[:k]):
            rows = {r: n for r, n in bag(a, t).items() if r[:k] == key}
            out[(*key, sum(r[1] * n for r, n in rows.items()), sum(rows.values()))] = 1
        return out

    check_law(x.reduce(k, nodes.total("v"), nodes.count()), want, depth)
    dropped = lambda t: {r: 1 for r in want(t) if r[-1]}
    check_law(x.reduce(k, nodes.total("v"), nodes.count(), empty_groups="drop"), dropped, depth)


def net_positive(seed, depth, n=40):
    """Random changes that keep every count at every time from going below zero."""
    r, out = random.Random(seed), []
    while len(out) < n:
        c = ((r.choice("ab") * r.randint(1, 2), float(r.randrange(3))), tuple(r.randrange(3) for _ in range(depth)), r.choice([-1, 1, 2]))
        if all(x >= 0 for t in all_times(depth) for x in bag([*out, c], t).values()):
            out.append(c)
    return out


@pytest.mark.parametrize("depth", [1, 2])
def test_law_of_minima_and_folds(spark, depth):
    a = net_positive(6, depth)
    x = log(spark, a, depth=depth)

    def want(t, value, init, drop):
        out = {}
        for (key,) in seen(a, t, lambda r: r[1:]):
            rows = sorted(((len(r[0]), r[0]), n) for r, n in bag(a, t).items() if r[1] == key)
            if rows or not drop:
                out[(key, value(rows) if rows else init)] = 1
        return out

    text = lambda rows: "".join(r[1] * n for r, n in rows)
    y = x.project("v", "k")
    for drop in (False, True):
        mode = "drop" if drop else "init"
        check_law(y.reduce(1, nodes.maximum("k"), empty_groups=mode), lambda t, d=drop: want(t, lambda rows: max(r[1] for r, _ in rows), None, d), depth)
        check_law(y.reduce(1, nodes.concatenation("k"), empty_groups=mode), lambda t, d=drop: want(t, text, None, d), depth)
    check_law(y.reduce(1, nodes.average(F.length("k"))), lambda t: want(t, lambda rows: sum(r[0] * n for r, n in rows) / sum(n for _, n in rows), None, False), depth)


def test_top_compact_and_plain_rows(spark):
    a = net_positive(7, 1)
    x = log(spark, a)
    first = lambda t: {r: 1 for k in {r[0] for r in bag(a, t)} for r in sorted((r for r in bag(a, t) if r[0] == k), key=lambda r: -r[1])[:1]}
    check_law(x.top(1, 1, F.desc("v")), first, 1)
    old, new = batch_of(x.changes()), batch_of(x.compact(2).changes())
    assert all(t >= (2,) for _, t, _ in new) and all(bag(old, (t,)) == bag(new, (t,)) for t in (2, 3))
    assert Counter(map(tuple, x.rows_as_of(2).collect())) == bag(a, (2,))
    with pytest.raises(Exception, match="negative"):
        log(spark, [(("a", 1.0), (0,), -1)]).rows_as_of(0).collect()


COALESCE = [([("a", 1), ("b", 1), ("a", -1)], [("b", 1)]), ([("a", 1), ("b", 1), ("a", -1), ("b", -1)], []), ([("a", 1), ("b", 1), ("a", 1), ("b", -1)], [("a", 2)]), ([("a", 1), ("a", -1), ("a", 1)], [("a", 1)]), ([("a", 0), ("a", 0), ("a", 1)], [("a", 1)]), ([("a", 0)] * 3, [])]


@pytest.mark.parametrize(("given", "want"), COALESCE)
def test_coalesce_cases(spark, given, want):
    got = batch_of(log(spark, [((r,), (0,), d) for r, d in given], "k string").changes())
    assert [(r[0], d) for r, _, d in got] == want


def rows(*items):
    return [(tuple(r), t if isinstance(t, tuple) else (t,), d) for r, t, d in items]


def test_join_cases(spark):
    def joined(left, right, k, schema="k string", depth=1):
        return batch_of(log(spark, left, schema, depth).join(log(spark, right, schema, depth), k).changes(), depth)

    assert joined(rows((["a"], (0, 1), 2)), rows((["a"], (1, 0), 3)), 1, depth=2) == rows((["a"], (1, 1), 6))
    assert joined(rows((["a"], (0, 1), 2)), rows((["b"], (1, 0), 3)), 1, depth=2) == []
    assert joined(rows((["a"], (0, 1), 2), (["a"], (0, 2), 5)), rows((["a"], (1, 0), 3), (["a"], (2, 0), 7)), 1, depth=2) == rows((["a"], (1, 1), 6), (["a"], (1, 2), 15), (["a"], (2, 1), 14), (["a"], (2, 2), 35))
    one = rows((["a"], 0, 1), (["a"], 1, 1), (["a"], 2, 1), (["c"], 0, 1), (["e"], 0, 1))
    assert joined(one, one, 1) == rows((["a"], 0, 1), (["a"], 1, 3), (["a"], 2, 5), (["c"], 0, 1), (["e"], 0, 1))
    two = rows((["a", "x"], 0, 1), (["a", "y"], 1, 1), (["a", "z"], 2, 1), (["c", "c"], 0, 1), (["e", "e"], 0, 1))
    assert joined(two, two, 2, "k string, v string") == two
    got = joined(two, two, 1, "k string, v string")
    at = {"x": 0, "y": 1, "z": 2}
    assert got == sorted(rows(*[(["a", l, r], max(at[l], at[r]), 1) for l in at for r in at], (["c", "c", "c"], 0, 1), (["e", "e", "e"], 0, 1)))


def test_as_of_counts(spark):
    given = [("a", 1, 1), ("b", 0, 1), ("c", 0, 1), ("a", 2, 2), ("e", 0, 1), ("f", 0, 1), ("a", 0, 1), ("h", 3, 1), ("i", 0, 1), ("c", 0, 2), ("k", 0, 1), ("l", 0, 1), ("c", 1, -3), ("n", 0, 1), ("o", 0, 1)]
    x = log(spark, [((r,), (t,), d) for r, t, d in given], "k string")
    got = [{r["k"]: r[DIFF] for r in x.as_of(t).collect()} for t in range(4)]
    assert [g["a"] for g in got] == [1, 2, 4, 4] and got[0]["c"] == 3 and "c" not in got[1]
    assert "h" not in got[0] and got[3]["h"] == 1 and "z" not in got[3]


def test_emptied_groups_negative_counts_and_order(spark):
    x = log(spark, [(("k", 1.0), (0,), 1), (("k", 1.0), (1,), -1)])
    full = [(("k", 0.0), (1,), 1), (("k", 1.0), (0,), 1), (("k", 1.0), (1,), -1)]
    assert batch_of(x.reduce(1, nodes.total("v")).changes()) == full
    assert batch_of(x.reduce(1, nodes.total("v"), empty_groups="drop").changes()) == full[1:]
    below = log(spark, [(("r",), (0,), -1)], "k string")
    assert batch_of(below.distinct().changes()) == [(("r",), (0,), 1)]
    with pytest.raises(Exception, match="negative"):
        below.reduce(0, nodes.concatenation("k")).changes().collect()
    texts = log(spark, [(("x", "b"), (0,), 1), (("x", "aa"), (0,), 2)], "k string, v string")
    assert batch_of(texts.reduce(1, nodes.concatenation("v")).changes()) == [(("x", "baaaa"), (0,), 1)]


def test_null_keys_and_plan_errors(spark):
    x = log(spark, [((None, 1.0), (0,), 1)])
    assert batch_of(x.join(x, 1).changes()) == [] and len(batch_of(x.join(x, 1, null_safe=True).changes())) == 1
    assert batch_of(x.distinct().changes()) == [((None, 1.0), (0,), 1)]
    for bad in (lambda: x.join(x, 3), lambda: x.union(x.project(0)), lambda: x.reduce(1), lambda: x.reduce(1, nodes.count(), empty_groups="x"), lambda: x.map(F.lit(1).alias("__t0")), lambda: x.join(log(spark, [], depth=2), 1)):
        with pytest.raises(PlanError):
            bad()


def test_files_round_trip(spark, tmp_path):
    x = log(spark, random_log(9, 2), depth=2)
    for kind in ("parquet", "orc"):
        logs.write(x, str(tmp_path / kind), kind)
        assert batch_of(logs.read_log(spark, str(tmp_path / kind), kind).changes(), 2) == batch_of(x.changes(), 2)
