import itertools
import math
import random

import numpy as np
import pytest

from tidelog.llm import vectors


def brute(rows, cosine):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ids, keep = [i for i, _ in rows], [k for k, (i, v) in enumerate(rows) if i is not None and good(v)]
    links, parent = [0] * len(rows), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(keep, 2):
        if len(rows[a][1]) != len(rows[b][1]):
            continue
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
            links[a] += 1
            links[b] += 1
            p, q = root(ids[a]), root(ids[b])
            parent[max(p, q)] = min(p, q)
    return sorted(((i, n, root(i) if i is not None else None, i is None or root(i) == i) for i, n in zip(ids, links, strict=True)), key=str)


@pytest.mark.parametrize(("d", "tile", "kind"), [(64, 4096, "float"), (64, 24, "float"), (33, 10, "double"), (2, 7, "float")])
def test_links_equal_brute_force(spark, d, tile, kind):
    r = random.Random(d + tile)
    rows = []
    for g in range(12):
        base = [r.gauss(0, 1) for _ in range(d)]
        for _ in range(r.choice([1, 3, 30])):
            noise = r.choice([0, 0.05, 0.2, 0.3])
            rows.append([float(np.float32(x + r.gauss(0, noise))) for x in base])
    rows += [rows[0]] * 9 + [[2 * x for x in rows[0]]] + [[r.gauss(0, 1) for _ in range(d)] for _ in range(60)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [None, [], [0.0] * d, [None, *rows[0][1:]], [math.nan, *rows[0][1:]], [math.inf, *rows[0][1:]], rows[0][:-1] if d > 2 else [1.0]]
    r.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, rows[0]), (3, rows[5])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], f"vec_id long, embedding array<{kind}>, rep int, label int").repartition(5)
    got = vectors.near_vectors(df, tile=tile).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.95)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).collect() == []


def test_every_close_pair_meets_in_a_block():
    r = np.random.default_rng(1)
    x = vectors.unit(r.normal(size=(300, 64)))
    y = vectors.unit(x + 0.03 * r.normal(size=x.shape))
    plan = vectors.Plan(x, 0.95, 40)
    close = np.flatnonzero((x * y).sum(1) >= 0.95)
    assert len(close) > 100
    for k in close:
        met = False
        for block in range(plan.n):
            home, row, cell = plan.cells(np.vstack((x[k], y[k])) @ plan.axes, block)
            seen = {(i, c) for i, c in zip(row.tolist(), cell.tolist(), strict=True)} | set(enumerate(home.tolist()))
            gap = ((x[k] - y[k]) @ plan.axes)[plan.parts[block]]
            if gap @ gap <= plan.budgets[block]:
                assert (0, min(home)) in seen and (1, min(home)) in seen
                met = True
        assert met
