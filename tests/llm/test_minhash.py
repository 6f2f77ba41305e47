import itertools
import random
import re

import numpy as np
import pytest

from tidelog.llm import graph, minhash
from tidelog.llm.words import shingle_sets, word_hashes


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_words_and_shingles_equal_brute_force():
    r = random.Random(2)
    texts = [None, "", "  \n", "one", "A B", "a b", "É x y", *["".join(r.choices("abAB \t\n\x0bé", k=r.randint(0, 60))) for _ in range(200)]]
    raw = [t.encode() if t is not None else None for t in texts]
    for k in (1, 3, 5):
        got, want = shingle_sets(raw, k), brute_sets(texts, k)
        assert [len(x) for x in got] == [len(x) for x in want]
        for i, j in itertools.combinations(range(0, len(texts), 3), 2):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    assert len(word_hashes([])[0]) == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, graph.connected_components(df).collect()))
    want = components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert graph.connected_components(df.limit(0)).collect() == []


def test_component_rounds_read_links_once_and_free_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    for star in (graph._large_star, graph._small_star):
        assert "Union" not in star(df)._jdf.queryExecution().optimizedPlan().toString()
    freed = []
    monkeypatch.setattr(graph.store, "let_go", lambda s, f=graph.store.let_go: freed.append(f(s)))
    assert {r.label for r in graph.connected_components(df).collect()} == {0}
    assert len(freed) > 1


def brute(rows, k, num, den):
    sets = brute_sets([t for _, t in rows], k)
    ids = [i for i, _ in rows]
    links = [(ids[i], ids[j]) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    comp = components(ids, links)
    return sorted((i, len(s), comp[i], comp[i] == i) for i, s in zip(ids, sets, strict=True))


@pytest.mark.parametrize(("k", "num", "tile"), [(3, 85, 16), (5, 80, 512)])
def test_near_duplicates_equal_brute_force(spark, k, num, tile):
    r, rows = random.Random(k), []
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(8):
        base = r.choices(vocabulary, k=r.choice([3, 20, 90]))
        for _ in range(r.choice([2, 10, 60])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [" ".join(r.choices(vocabulary, k=50)) for _ in range(40)] + ["", None, "  ", "one", "ONE", "one two", "long " * 30000 + "end"] + [rows[0]] * 30
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, key int").repartition(6)
    got = minhash.near_duplicates(df, k=k, num=num, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, num, 100)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other text"), (None, "other text"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, k=3).collect()), key=str) == sorted([(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []
    kept = minhash.deduplicate(df.unionByName(spark.createDataFrame([(2, "A B C D E F")], df.schema)), k=3).collect()
    assert sorted((x.doc_id or -1) for x in kept) == [-1, -1, -1, 1, 3]


def test_tile_forest_finds_every_joinable_component():
    r = random.Random(4)
    base = list(range(40))
    sets = [np.unique(np.array([r.randrange(60) if r.random() < 0.1 else x for x in base], np.uint64)) for _ in range(60)]
    links = [(i, j) for i, j in itertools.combinations(range(60), 2) if (n := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 85 * (len(sets[i]) + len(sets[j]) - n)]
    found = minhash.tile_forest(list(range(60)), list(range(60)), [True] * 60, sets, 85, 100)
    assert components(range(60), links) == components(range(60), found) and len(found) < 60
