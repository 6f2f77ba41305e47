import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelog.llm import exchange, katz


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def counts_of_counts(counts):
    return [sum(v == c for v in counts) for c in range(katz.K + 2)]


class Brute:
    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
        self.c1 = Counter(x for t in train for x in t)
        self.c2 = Counter(p for t in train for p in zip(["<begin>", *t], t))
        self.total = sum(self.c1.values())
        self.d1, self.unknown = katz.discounts(counts_of_counts(self.c1.values()), self.total)
        self.scale = 1.0
        if not self.unknown:
            self.scale, self.unknown = self.total / (self.total + 1), 1 / (self.total + 1)
        self.d2, _ = katz.discounts(counts_of_counts(self.c2.values()), self.total)
        self.after = defaultdict(dict)
        for (h, w), n in self.c2.items():
            self.after[h][w] = n

    def p1(self, w):
        c = self.c1[w]
        return self.scale * self.d1[min(c, katz.K + 1)] * c / self.total if c else self.unknown

    def p2(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        total = sum(seen.values()) + (min(seen.values()) > katz.K)
        if w in seen:
            return self.d2[min(seen[w], katz.K + 1)] * seen[w] / total
        left = 1 - sum(self.d2[min(n, katz.K + 1)] * n for n in seen.values()) / total
        return left / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.c1[x] + 0.1) / (self.total + 0.1 * (len(self.c1) + 1))) for x in t)
        score = sum(math.log10(self.p2(h, w)) for h, w in zip(["<begin>", *t], t))
        return (i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(self.c1[x] > 0 for x in t), self.total, base, score)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(katz, "WORDS_A_BUCKET", 60)
        monkeypatch.setattr(katz, "TOKENS_A_BUCKET", 400)
        monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    r = random.Random(7)
    words = [f"w{i}" for i in range(150)] + ["É", "WORD", "a-b"]
    rows = [(i, " ".join(words[min(152, int(r.expovariate(0.06)))] for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(1001, None), (1002, ""), (None, "w1 w2"), (5, rows[5][1]), (1010, "long w3 " * 3000), (None, "brand new")]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, block int, key string").repartition(5)
    model = Brute(rows)
    assert any(x[1] for x in map(lambda x: model.row(*x), rows))
    close([tuple(x) for x in katz.score(df).collect()], [model.row(*x) for x in rows])
    for h in ["<begin>", "w0", "w3", "long", "nowhere", "É"]:  # exactly normalised, the unknown word included
        assert sum(model.p2(h, w) for w in model.c1) + model.p2(h, "\0unknown") == pytest.approx(1, abs=1e-12)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    r = random.Random(2)
    follow = {w: r.choices(range(60), k=3) for w in range(60)}
    rows = []
    for i in range(400):
        w, out = r.randrange(60), []
        for _ in range(30):
            w = r.choice(follow[w])
            out.append(f"x{w}")
        rows.append((i, " ".join(out)))
    got = [x for x in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert got and sum(x.score for x in got) > 0.6 * sum(x.base_score for x in got)


def test_few_or_no_training_texts(spark):
    out = next(str(i) for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = spark.createDataFrame([(int(out), "a b")], "doc_id long, text string")
    assert [tuple(x) for x in katz.score(only).collect()] == [(int(out), True, 3, 0, 0, 0.0, 0.0)]
    assert katz.score(only.limit(0)).collect() == []
    many = [(1, "a a a a a a a a a a")] * 7
    close([tuple(x) for x in katz.score(spark.createDataFrame(many, "doc_id long, text string")).collect()], [Brute(many).row(*x) for x in many])


def test_discounts_fall_back():
    good, left = katz.discounts([0, 1000, 400, 220, 140, 100, 76], 10_000)
    assert all(0 < x < 1 for x in good[1:6]) and good[6] == 1 and 0 < left < 1
    odd, _ = katz.discounts([0, 1, 0, 0, 0, 0, 9], 55)
    assert odd[1] == pytest.approx(0.25) and np.all(np.diff(odd[1:]) > 0)


def test_good_turing_stays_where_one_count_of_counts_is_lifted():
    n = [0, 1655711, 262472, 56325, 23262, 20048, 8151]  # bigrams of sf0.1; planted copies lift n[5], so 4* > 4
    d, left = katz.discounts(n, 3_643_802)
    assert ((d[1:6] > 0) & (d[1:6] < 1)).all() and d[6] == 1 and left == pytest.approx(n[1] / 3_643_802)
    turing = [(c + 1) * n[c + 1] / (c * n[c]) for c in (1, 2, 3)]  # these counts keep their own Good-Turing counts
    assert (1 - d[1:4]) / (1 - d[1]) == pytest.approx((1 - np.array(turing)) / (1 - turing[0]))
    assert np.all(np.diff(d[1:]) > 0) and abs(d[1] - 0.25) > 0.02
    gap, left = katz.discounts([0, 900, 110, 0, 14, 0, 5], 5000)  # empty counts of counts are fitted over
    assert ((gap[1:6] > 0) & (gap[1:6] < 1)).all() and np.all(np.diff(gap[1:]) > 0) and not np.allclose((1 - gap[1:6]) * np.arange(1, 6), 1 - gap[1])


def test_packed_arrays_round_trip():
    for a in (np.array([], np.int64), np.array([-1, 5]), np.array([2**64 - 1, 0], np.uint64), np.arange(300), np.array([0.5, 1e300]), np.zeros(9, np.uint8)):
        assert np.array_equal(exchange.unpack(exchange.pack(a, a[:1]))[0], a)
