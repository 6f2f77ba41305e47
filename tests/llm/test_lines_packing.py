import random
from collections import Counter, defaultdict

import pytest

from tidelog.llm import lines, packing


def brute_lines(rows, ratio, least):
    pages, counts = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        counts.update({(h, x) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in counts.items() if n >= least and n > pages[k[0]] * ratio}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for i, h, t in rows), key=str)


@pytest.mark.parametrize("limit", [500_000, -1])
def test_lines_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", None, f"h{i}"]), r.choice([None, "", "\n".join(r.choices(["menu", "foot", " ", "", "x", f"own {i}", f"two {i // 2}"], k=r.randint(1, 9)))])) for i in range(300)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, source string, text string, n int, pages int")
    got = lines.drop_boilerplate(df, ratio=0.2, min_pages=3, counts=("n_lines", "n_dropped"))
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    out = got.collect()
    assert sorted(((x.doc_id, x.text) for x in out), key=str) == brute_lines(rows, 0.2, 3)
    text = {i: t for i, _, t in rows}
    for x in out:
        n = 0 if text[x.doc_id] is None else len(text[x.doc_id].split("\n"))
        assert x.n_lines == n and (x.n_dropped == 0) == (text[x.doc_id] == x.text)
    assert lines.drop_boilerplate(df.limit(0)).collect() == []


def test_host(spark):
    urls = ["http://User@Ex.Com:80/a?b", "https://m.a.org#x", "x", None, "ftp://h"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(lines.host_of("u")).collect()
    assert [x[0] for x in got] == ["ex.com", "m.a.org", None, None, "h"]


def check_sequences(rows, capacities, width=1):
    """Each sequence is the smallest that holds its pieces, which lie one after another; (doc, piece) -> ids."""
    found = defaultdict(list)
    assert len({x.bin_id for x in rows}) == len(rows)
    for x in rows:
        assert x.capacity == min(c for c in capacities if c >= x.n_tokens) and len(x.tokens) == x.n_tokens * width
        at = 0
        for i, piece, start, n in zip(x.doc_ids, x.pieces, x.starts, x.lengths, strict=True):
            assert start == at and 0 < n <= max(capacities)
            found[i, piece].append(bytes(x.tokens[start * width : (start + n) * width]))
            at += n
        assert at == x.n_tokens
    return found


def test_packing_keeps_every_token_once(spark):
    r = random.Random(1)
    texts = [(i if i % 50 else None, r.choice([None, "", "é", "x" * 30, "ab" * 1000, "c" * 2047, "d" * 2048, "e" * 32767, "f" * 32768, "long " * 20000])) for i in range(300)]
    texts += [(7, "same"), (7, "same"), (7, "other")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, shard string, row int").repartition(3)
    for size in (12 << 20, 300_000):
        got = packing.pack(df, shard_bytes=size).collect()
        found = check_sequences(got, packing.CAPACITIES)
        most, want = packing.CAPACITIES[-1], defaultdict(list)
        for i, t in texts:
            raw = (t or "").encode() + packing.END
            for p in range(0, len(raw), most):
                want[i, p // most].append(raw[p : p + most])
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        assert sum(x.n_tokens for x in got) / sum(x.capacity for x in got) > 0.9
    assert packing.pack(df.limit(0)).collect() == []


def test_packing_ids_of_a_column(spark):
    r = random.Random(2)
    ids = [(i, bytes(r.randrange(256) for _ in range(4 * r.choice([0, 1, 5, 16, 17, 40])))) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(ids, "doc_id long, ids binary")
    found = check_sequences(packing.pack(df, ids="ids", width=4, capacities=(8, 16), overhead=1).collect(), (8, 16), 4)
    assert {k: v for k, v in found.items()} == {(i, p // 64): [b[p : p + 64]] for i, b in ids if b for p in range(0, len(b), 64)}


def naive_best_fit(lengths, sizes, overhead):
    """The rule as it is said, with a list of bins searched in full."""
    best = None
    for largest in sizes:
        if largest < max(lengths):
            continue
        bins, rest = [], sum(lengths)
        for n in sorted(lengths, reverse=True):
            rest -= n
            fits = [x for x in bins if x[0] >= n]
            if fits:
                x = min(fits, key=lambda x: x[0])
            else:
                x = [min((c for c in sizes if n <= c <= largest), key=lambda c: ((c + overhead) / min(c, n + rest), c)), 0]
                bins.append(x)
            x[0], x[1] = x[0] - n, x[1] + n
        cost = sum(min(c for c in sizes if c >= used) + overhead for _, used in bins)
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_equals_the_naive_rule(seed):
    r = random.Random(seed)
    sizes = sorted(r.sample([4, 8, 10, 16, 32, 64], r.randint(1, 4)))
    lengths = [r.randint(1, sizes[-1]) for _ in range(r.randint(1, 60))]
    placed, caps = packing.best_fit(lengths, tuple(sizes), 3)
    used = Counter()
    for (b, at), n in zip(placed, lengths, strict=True):
        assert at + n <= caps[b]
        used[b] += n
    assert all(caps[b] == min(c for c in sizes if c >= used[b]) for b in used)
    assert sum(caps) + 3 * len(caps) == naive_best_fit(lengths, sizes, 3)


def test_best_fit_small_cases():
    placed, caps = packing.best_fit([512, 512, 1000, 24], (512, 1024, 2048), 0)
    assert sum(caps) == 2048 and len({b for b, _ in placed}) == len(caps)
    assert packing.best_fit([], (8,)) == ([], [])
    assert packing.best_fit([3], (4, 8), 1)[1] == [4]
